"""Command line: ``python -m braid {init,search,explain,doctor,plan} TABLE.parquet ...``."""

from __future__ import annotations

import argparse
import dataclasses
import json
import sys

from pyspark.sql import SparkSession

from braid.config import Weights
from braid.operators.doctor import doctor
from braid.operators.explain import explain
from braid.operators.search import HybridSearch
from braid.plans.build import build_plan, suggest_config


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="braid")
    parser.add_argument("command", choices=["init", "search", "explain", "doctor", "plan"])
    parser.add_argument("table")
    parser.add_argument("text", nargs="?")
    parser.add_argument("--embedding", help="JSON, or @file with JSON")
    parser.add_argument("--embedding-from", help="id of a row whose vector is used")
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--near-miss", type=int, default=10)
    parser.add_argument("--find")
    parser.add_argument("--fusion", choices=["rrf", "weighted"])
    parser.add_argument("--language")
    parser.add_argument("--weights", help="vector,text")
    parser.add_argument("--highlight", action="store_true")
    parser.add_argument("--json", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.getOrCreate()
    try:
        table = spark.read.parquet(args.table)
        config = suggest_config(table)
        if args.language:
            config = dataclasses.replace(config, language=args.language)
        if args.weights:
            config = dataclasses.replace(config, weights=Weights(*map(float, args.weights.split(","))))
        if args.command == "init":
            for s in build_plan(table, config):
                print(f"{'required' if s.required else 'optional'}: {s.what} ({s.why})")
            return 0
        if args.command == "doctor":
            findings = doctor(table, config)
            print("\n".join(f"{f.level}: {f.what} {f.advice}".rstrip() for f in findings))
            return int(any(f.level == "error" for f in findings))
        search = HybridSearch(table, config)
        vector = None
        if args.embedding:
            vector = json.load(open(args.embedding[1:])) if args.embedding.startswith("@") else json.loads(args.embedding)
        elif args.embedding_from:
            vector = search.vector_of(args.embedding_from)
        if args.command == "explain":
            print(explain(search, args.text, vector, limit=args.limit, near_miss=args.near_miss, find=args.find, fusion=args.fusion).to_text())
            return 0
        page = search.search(args.text, vector, limit=args.limit, fusion=args.fusion, highlight=args.highlight)
        if args.command == "plan":
            page.explain("formatted")
        elif args.json:
            print("\n".join(page.toJSON().collect()))
        else:
            page.show(args.limit, truncate=60)
        return 0
    except ValueError as e:
        print(f"braid: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
