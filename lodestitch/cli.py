"""Command line: ``python -m lodestitch.cli COMMAND``."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from lodestitch.operators import review
from lodestitch.operators.resolve import Thresholds
from lodestitch.plans.linkage import Linkage, Result
from lodestitch.session import local_session
from lodestitch.sources import datagen, files
from lodestitch.sources.state import Store


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="lodestitch")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("generate-data", help="write made-up source files and their truth")
    p.add_argument("--out", default="data")
    p.add_argument("--n-entities", type=int, default=350)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--confusable-fraction", type=float, default=0.12)
    p.add_argument("--missing-field-rate", type=float, default=0.12)
    p = commands.add_parser("run-all", help="link the sources of a folder and report")
    p.add_argument("--data-dir", default="data")
    p.add_argument("--match-threshold", type=float, default=Thresholds.match)
    p.add_argument("--no-match-threshold", type=float, default=Thresholds.no_match)
    p.add_argument("--sample-size", type=int, default=300)
    p.add_argument("--db", default=None, help="folder of the state tables")
    p.add_argument("--report-out", default=None)
    for name, text in (("review-queue", "show pairs that wait for a decision"), ("export-review-queue", "write them to a CSV file")):
        p = commands.add_parser(name, help=text)
        p.add_argument("--db", required=True)
        p.add_argument("--limit", type=int, default=20) if name == "review-queue" else p.add_argument("--out", default="review_queue.csv")
    p = commands.add_parser("submit-review", help="record a reviewer's decision")
    p.add_argument("pair_id", type=int)
    p.add_argument("decision", choices=("match", "no_match"))
    p.add_argument("--db", required=True)
    p.add_argument("--reviewer", default="reviewer")
    return parser


def report(result: Result) -> str:
    m = result.metrics
    lines = [
        f"entities: {m['n_entities']}   candidate pairs: {m['n_candidate_pairs']}   true pairs: {m['n_true_match_pairs']}",
        f"blocking recall: {m['blocking_recall']:.3f} ({m['blocking_missed']} missed)",
        f"all pairs: precision {m['full_dataset_precision']:.3f}  recall {m['full_dataset_recall']:.3f}  F1 {m['full_dataset_f1']:.3f}",
        f"decisions: {m['n_matches']} match, {m['n_no_matches']} no match, {m['n_review_queue']} to review",
        f"clusters: {m['n_clusters']} ({m['n_flagged_conflict_clusters']} flagged)",
    ]
    if "hand_label_sample_size" in m:
        lines.append(f"hand labels ({m['hand_label_sample_size']}): precision {m['hand_label_precision']:.3f}  recall {m['hand_label_recall']:.3f}  F1 {m['hand_label_f1']:.3f}")
    return "\n".join(lines)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    spark = spark or local_session()
    if args.command == "generate-data":
        made = datagen.generate(spark, args.n_entities, args.confusable_fraction, args.seed, args.missing_field_rate)
        for name, path in datagen.write_dataset(made, args.out, args.seed).items():
            print(f"{name}: {path}")
        return 0
    if args.command == "run-all":
        truth = f"{args.data_dir}/ground_truth.csv"
        if not files.exists(spark, truth):
            print(f"no ground truth at {truth}", file=sys.stderr)
            return 1
        plan = Linkage(Thresholds(args.match_threshold, args.no_match_threshold), sample_size=args.sample_size)
        result = plan.run(files.load_all_sources(spark, args.data_dir), files.load_ground_truth(spark, truth))
        print(report(result))
        if args.report_out:
            Path(args.report_out).write_text(json.dumps(result.metrics, indent=2))
        if args.db:
            Store(spark, args.db).save_run(result.raw, result.entities, result.resolution.pairs)
        return 0
    with Store(spark, args.db) as store:
        if args.command == "submit-review":
            if not store.review_queue().where(f"id = {args.pair_id}").count():
                print(f"pair {args.pair_id} does not wait for review; recorded all the same")
            store.decide(args.pair_id, args.decision, args.reviewer)
            print(f"pair {args.pair_id}: {args.decision} by {args.reviewer}")
            return 0
        queue = store.review_queue()
        n = queue.count()
        if not n:
            print("Review queue is empty.")
            return 0
        entities = store.read("normalized_entities", False)
        if args.command == "review-queue":
            print(f"{n} pairs to review")
            for row in review.explain(queue.orderBy("id").limit(args.limit), entities).orderBy("id").collect():
                print(review.format_explanation(row))
        else:
            print(f"wrote {review.export_queue(review.explain(queue, entities), args.out)}")
        return 0


if __name__ == "__main__":
    sys.exit(main())
