"""``python -m weirflow validate|run|schema``."""

from __future__ import annotations

import argparse
import json
import logging
import sys

import yaml

from .config import load_config
from .config.format import Document
from .errors import WeirflowError


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="weirflow")
    parser.add_argument("-v", "--verbose", action="count", default=0)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("validate", "run"):
        sub = commands.add_parser(name)
        sub.add_argument("blueprint")
        sub.add_argument("--param", action="append", default=[], metavar="K=V")
        sub.add_argument("--strict", action="store_true", help="tokens without a value are errors (validate)")
    commands.add_parser("schema")
    args = parser.parse_args(argv)
    logging.basicConfig(level=[logging.WARNING, logging.INFO, logging.DEBUG][min(args.verbose, 2)], format="%(asctime)s %(levelname)s %(message)s")
    if args.command == "schema":
        print(json.dumps(Document.model_json_schema(), indent=2))
        return 0
    try:
        params = dict(p.split("=", 1) for p in args.param)
    except ValueError:
        print("--param takes K=V", file=sys.stderr)
        return 1
    try:
        config = load_config(args.blueprint, params={k: yaml.safe_load(v) for k, v in params.items()}, strict=args.strict or args.command == "run")
        from .plans import Orchestrator

        orchestrator = Orchestrator(config)
        if args.command == "validate":
            print("valid: " + " -> ".join(orchestrator.order()))
            return 0
        ctx = orchestrator.run()
        for result in ctx.load_results:
            print(result)
    except WeirflowError as e:
        print(f"{type(e).__name__}: {e}", file=sys.stderr)
        return 1
    return 0
