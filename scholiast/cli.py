"""Command line: highlight-plan over a table of documents, render-highlights and manifest over stored plans."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import SparkSession

from .functions.text import slug
from .plans import highlight as H
from .plans.scorer import HttpScorer, OfflineScorer, TracedScorer
from .schema import PLAN
from .sources import layout, stores

__all__ = ["main", "slug"]


def config(args, env=os.environ) -> tuple[str, str, str]:
    """Address, key and model: from the arguments, else the environment."""
    return (args.base_url or env.get("SCHOLIAST_BASE_URL", ""), args.api_key or env.get("SCHOLIAST_API_KEY", ""), args.model or env.get("SCHOLIAST_MODEL", ""))


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="scholiast")
    sub = p.add_subparsers(dest="command", required=True)
    plan = sub.add_parser("highlight-plan", help="plan annotations for a table of documents (doc_id, text)")
    plan.add_argument("documents")
    plan.add_argument("out")
    for name, most in (("highlights", 3), ("notes", 3), ("equations", 2), ("equation-notes", 2)):
        plan.add_argument(f"--max-{name}-per-page", type=int, default=most)
    for name in ("base-url", "api-key", "model"):
        plan.add_argument(f"--{name}", default="")
    plan.add_argument("--trace", default="", help="folder for the events of the run")
    r = sub.add_parser("render-highlights", help="what to draw for stored plans: notes, places and connectors")
    r.add_argument("documents")
    r.add_argument("plans")
    r.add_argument("out")
    m = sub.add_parser("manifest", help="count what stored plans hold")
    m.add_argument("plans")
    m.add_argument("out")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "manifest":
        stores.write_json(H.manifest(stores.read_plan(spark, a.plans, PLAN)), a.out)
        return 0
    if a.command == "render-highlights":
        pages = layout.document_blocks(spark.read.parquet(a.documents)).select("doc_id", "page_number", "page_width", "page_height").distinct()
        stores.write_json(H.drawings(stores.read_plan(spark, a.plans, PLAN), pages), a.out)
        return 0
    url, key, model = config(a)
    if bool(url) != bool(model):
        raise SystemExit("an endpoint needs both an address and a model")
    scorer = HttpScorer(url, model, key) if url else OfflineScorer()
    if url:
        scorer.models()
    if a.trace:
        scorer = TracedScorer(scorer, a.trace, "cli", strict=True)
    b = layout.document_blocks(spark.read.parquet(a.documents))
    caps = H.Caps(a.max_highlights_per_page, a.max_notes_per_page, a.max_equations_per_page, a.max_equation_notes_per_page)
    stores.write_json(H.build(b, None, scorer, caps), a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
