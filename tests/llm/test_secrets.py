import hashlib
import random
import re
import time

from lodestitch.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def base(text):
    text = text or ""
    spans = [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    spans += [(m.start(), 1, m.end(), m[0]) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    spans += [(m.start(), 2, m.end(), m[0]) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(spans)


def brute(rows):
    found, owners = [], {}
    for doc, text, owner in rows:
        spans = base(text)
        more = [(m.start(), 3, m.end(), m[0]) for m in re.finditer("[A-Za-z0-9+/_=-]{20,}", text or "") if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0]) and not any(s < m.end() and m.start() < e for s, _, e, _ in spans)]
        found.append((doc, spans, more))
        for *_, value in spans + more:
            owners.setdefault(value, set()).add(owner)
    out = {}
    for doc, spans, more in found:
        name = lambda s: f"{secrets.KINDS[s[1]]}:{s[0]}:{s[2]}"
        full = sorted(spans + [s for s in more if len(owners[s[3]]) == 1])
        out[doc] = tuple(sum(s[1] == k for s in spans) for k in range(3)) + (hashlib.sha256(",".join(map(name, spans)).encode()).hexdigest(), ",".join(map(name, full)))
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    bits = ["password", "PASSWD", "secret", "token", "Api_key", "apikey", ":", "=", " ", "'", '"', "abc", "é😀", "AKIA", "ABCDEFGH12345", "deadbeef", "0123456789abcdef", "x1y2z3w4v5u6t7s8r9q0", ".", "\n", "K9"]
    rows = [(d, "".join(rng.choice(bits) for _ in range(rng.randrange(60))), f"s{rng.randrange(3)}") for d in range(300)]
    rows += [(900, None, "s1"), (901, "", None), (902, "token=" + "a" * 50_000, None), (903, "key Zz9" + "y7" * 20, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.digest(secrets.scan(df)).collect()}
    assert got == brute(rows)


def test_live_and_copied(spark):
    key = "Zx81" * 6
    rows = [(1, f"use {key} now", "a"), (2, f"use {key} now", "b"), (3, "use Qw12Er34Ty56Ui78Op90 now", "a"), (3, "use Qw12Er34Ty56Ui78Op90 now", "a"), (None, "token: abcdefgh", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((str(r.doc_id), r.spans, r.n_live, r.n_copied) for r in secrets.digest(secrets.scan(df)).collect())
    assert got == [("1", "", 0, 0), ("2", "", 0, 0), ("3", "live:4:24", 1, 0), ("3", "live:4:24", 1, 0), ("None", "assign:0:15", 1, 0)]
    assert secrets.scan(df.limit(0)).count() == 0


def test_many_repositories_of_one_owner_are_copies(spark):
    key, few = "Zx81" * 6, "Qw12" * 6
    rows = [(d, f"use {key} now", "a") for d in range(secrets.MAX_LIVE_REPOS + 1)] + [(100 + d, few, "a") for d in range(secrets.MAX_LIVE_REPOS)]
    got = secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    assert {(r.doc_id < 100, r.spans, r.n_live) for r in got} == {(True, "", 0), (False, "live:0:24", 1)}


def redacted(text, spans):
    out, at = "", 0
    for start, _, end, _ in sorted(spans):
        if end > at:
            if start > at or not out and not at:
                out += text[at:start] + "[secret]"
            at = end
    return out + text[at:]


def test_redaction(spark):
    rng = random.Random(9)
    bits = ["password:", "AKIA", "ABCDEFGHIJKLM", "0123456789abcdef" * 2, " ", "é😀", "word ", "token=hunter2hunter2", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(200)] + [None, "", "token=hunter2hunter2", "x" * 10 + "password: hunter2hunter2 é😀 " * 500]
    rows = [(rng.choice([None, 1, d]), t, "s", 1, 2, [3]) for d, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, key int, cuts int, `a.b c` array<int>").repartition(3)
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted((str(r.doc_id), r.text or "", r.text is None) for r in out.collect())
    assert got == sorted((str(d), redacted(t or "", base(t)), t is None) for d, t, *_ in rows)


def test_work_is_linear_in_spans(spark):
    text = "token=hunter2hunter2 and " * 20_000
    df = spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")
    start = time.time()
    assert secrets.digest(secrets.scan(df)).first().n_assign == 20_000
    assert secrets.redact(df).first().text == "[secret] and " * 20_000
    assert time.time() - start < 60
