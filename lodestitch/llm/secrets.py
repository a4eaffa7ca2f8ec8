"""Secret scan with corpus-wide ownership frequency.

Three kinds of secrets are found by form alone (the base).  A fourth kind, ``live``,
is found by form and by who holds it: a long token of letters and digits outside the
base spans whose value the whole corpus holds in one owner's documents only, and in
``MAX_LIVE_REPOS`` repositories at most.  Values that several owners or more repositories
carry are copied examples and fixtures; the same decision is reported for the base
spans, as ``n_live`` and ``n_copied``.

All expressions are Spark's own.  A regular expression's match positions come from the
lengths of the pieces that ``split`` leaves and of the matches that ``regexp_extract_all``
returns: one row each, summed up along the text by a window, so the work is linear in the
number of matches of a text.  Counting dedupes a value per repository, then per owner,
then over owners, each with map-side partial sums, so a value in a third of all documents
is a handful of rows by the time it is shuffled.  The counts are written, so that the
occurrences of such a value meet them in a join that Spark can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestitch.operators.scratch import Scratch

# The kinds of secrets, in order, with pattern, group that holds the value, and least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
#: A token of some length that may be a credential if it mixes letters and digits.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "live")
LIVE = 3
#: Owners and repositories that hold a live value at most.
MAX_LIVE_OWNERS, MAX_LIVE_REPOS = 1, 5
#: Spans of a text from which on it is cut by its code points, not by searching for each cut.
_MANY = 32


def _pieces(text: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Array ``(kind, i, gap, size, value)`` of leftmost non-overlapping matches.

    The value is null where it has less than ``least`` code points.  ``[0-9a-f]{32,}``
    finds what ``[0-9a-f]+`` finds at 32 characters or more, as a match always runs to the
    end of its run; likewise for the access keys.
    """
    gaps = F.split(text, pattern, -1)
    match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    found = F.filter(F.arrays_zip(gaps.alias("gap"), match.alias("match"), value.alias("value")), lambda m: m["match"].isNotNull())
    good = lambda v: F.length(v) >= least
    if kind == LIVE:
        good = lambda v: (F.length(v) >= least) & v.rlike("[0-9]") & v.rlike("[A-Za-z]")
    rows = F.transform(found, lambda m, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(m["gap"]).alias("gap"), F.length(m["match"]).alias("size"), F.when(good(m["value"]), m["value"]).alias("value")))
    return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,size:int,value:string>>"))


def find_spans(rows: DataFrame) -> DataFrame:
    """``(row, owner, repo, kind, start, end, value)`` from rows that have ``pieces``.

    Tokens that overlap a base span are left out.
    """
    each = rows.where(F.size("pieces") > 0).select("row", "owner", "repo", F.explode("pieces").alias("p")).select("row", "owner", "repo", "p.*").repartition("row")
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(along).cast("int")).where("value is not null").withColumn("start", F.col("end") - F.col("size"))
    base = F.col("kind") != LIVE
    up = Window.partitionBy("row").orderBy(F.col("start")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    down = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    spans = spans.withColumn("before", F.max(F.when(base, F.col("end"))).over(up)).withColumn("after", F.min(F.when(base, F.col("start"))).over(down))
    apart = (F.coalesce("before", F.lit(-1)) <= F.col("start")) & (F.coalesce("after", F.col("end")) >= F.col("end"))
    return spans.where(base | apart).select("row", "owner", "repo", "kind", "start", "end", "value")


def ownership(spans: DataFrame) -> DataFrame:
    """``(hash, owners, repos)``: distinct owners and repositories that hold each value."""
    per_repo = spans.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = per_repo.groupBy("hash", "owner").agg(F.count("one").alias("repos"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def is_live(owners: Column, repos: Column) -> Column:
    return (owners <= MAX_LIVE_OWNERS) & (repos <= MAX_LIVE_REPOS)


def _scan(rows: DataFrame, store: Scratch) -> tuple[DataFrame, DataFrame]:
    """From rows of ``(key, body, owner, repo)``: the rows as ``(row, key)``, and their spans, one by one."""
    text = F.coalesce(F.col("body").cast("string"), F.lit(""))
    pieces = F.concat(_pieces(text, 0, ASSIGN, 2, 8), _pieces(text, 1, ACCESS, 0, 16), _pieces(text, 2, HEX, 0, 32), _pieces(text, LIVE, TOKEN, 0, 20))
    none = F.lit("\x00")
    found = store.write(rows.select(F.monotonically_increasing_id().alias("row"), "key", F.coalesce(F.col("owner").cast("string"), none).alias("owner"), F.coalesce(F.col("repo").cast("string"), none).alias("repo"), pieces.alias("pieces")))
    spans = store.write(find_spans(found).withColumn("hash", F.sha2("value", 256)))
    counts = store.write(ownership(spans))
    known = spans.select("row", "kind", "start", "end", "value", "hash").join(counts, "hash").drop("hash")
    return found.select("row", "key"), known.where((F.col("kind") != LIVE) | is_live(F.col("owners"), F.col("repos")))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repo_col: str = "doc_id") -> DataFrame:
    """Secrets of every row: ``(doc_id, spans)``.

    ``spans`` is an array of ``(start, kind, end, value, owners, repos)`` by start and
    kind; offsets are code points, end exclusive, and kind indexes ``KINDS``.

    * A null text is empty and gives no spans.  A null owner is one owner, a null
      repository one repository.
    * Repeated rows and null ids are rows of their own in the result; as they share
      owner and repository they do not make a value look copied.
    * Other columns are ignored, whatever their names.  An empty table gives an empty result.
    """
    store = Scratch(docs.sparkSession, "secrets")
    rows, spans = _scan(docs.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("body"), F.col(owner_col).alias("owner"), F.col(repo_col).alias("repo")), store)
    each = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "value", "owners", "repos"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,value:string,owners:bigint,repos:bigint>>")
    return rows.join(each, "row", "left").select(F.col("key").alias("doc_id"), F.coalesce("spans", none).alias("spans"))


def _without(text: Column, cuts: Column, mask: str) -> Column:
    """``text`` with the sorted, disjoint ``(start, end)`` of ``cuts`` replaced by ``mask``."""
    last = F.size(cuts)
    low = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(cuts, i - 1)["end"])
    high = lambda i: F.when(i == last, F.lit(2**31 - 1)).otherwise(F.get(cuts, i)["start"])
    gaps = F.sequence(F.lit(0), last)
    few = F.array_join(F.transform(gaps, lambda i: F.substr(text, low(i) + 1, high(i) - low(i))), mask)
    points = F.array(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)))  # in an array, so that it is made once
    many = F.transform(points, lambda p: F.array_join(F.transform(gaps, lambda i: F.array_join(F.slice(p, low(i) + 1, high(i) - low(i)), "")), mask))
    return F.when(last < _MANY, few).otherwise(many.getItem(0))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", mask: str = "[secret]") -> DataFrame:
    """``docs`` with the spans that ``scan`` reports replaced by ``mask``, spans that touch by one.

    Rows are matched by 128 bits of hash of id and text, so repeated rows and null ids are
    redacted alike; a null text stays null, and columns of any other names stay as they are.
    """
    store = Scratch(docs.sparkSession, "redact")
    quoted = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    text = F.coalesce(F.col(f"doc.{text_col}").cast("string"), F.lit(""))
    key = F.struct(F.xxhash64(f"doc.{id_col}", text).alias("a"), F.xxhash64(F.lit(1), text, f"doc.{id_col}").alias("b"))
    whole = docs.select(F.struct(*quoted).alias("doc")).withColumn("key", key)
    rows, spans = _scan(whole.select("key", text.alias("body"), F.col(f"doc.{owner_col}").alias("owner"), F.col(f"doc.{id_col}").alias("repo")), store)
    order = Window.partitionBy("row").orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = spans.select("row", "start", "end", F.coalesce(F.col("start") > reach, F.lit(True)).cast("int").alias("new"))
    islands = islands.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    cuts = islands.groupBy("row", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    cuts = store.write(rows.join(cuts, "row").groupBy("key").agg(F.first("cuts").alias("cuts")))
    joined = whole.join(cuts, "key", "left")
    clean = F.when(F.col("cuts").isNotNull(), _without(text, F.col("cuts"), mask)).otherwise(F.col("doc").getField(text_col))
    return joined.select(*[(clean if c == text_col else F.col("doc").getField(c)).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """The counts and joined forms of ``scan``'s spans."""
    name = lambda k: F.element_at(F.array(*map(F.lit, KINDS)), k + 1)
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda test: F.size(F.filter("spans", test)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != LIVE)
    return found.select(
        "doc_id",
        count(lambda s: s["kind"] == 0).alias("n_assign"),
        count(lambda s: s["kind"] == 1).alias("n_access"),
        count(lambda s: s["kind"] == 2).alias("n_hex"),
        F.sha2(text(base), 256).alias("base_sha256"),
        text(F.col("spans")).alias("spans"),
        count(lambda s: is_live(s["owners"], s["repos"])).alias("n_live"),
        count(lambda s: ~is_live(s["owners"], s["repos"])).alias("n_copied"),
    )
