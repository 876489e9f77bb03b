"""Command line: python -m tiltyard.cli COMMAND --help."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from tiltyard.plans import commands
from tiltyard.session import session

#: Command: (function, positional arguments, options with their types).
COMMANDS = {
    "extract": (None, ("url", "table", "key", "lower", "upper", "partitions", "out"), {}),
    "collect-api": (commands.do_collect, ("log", "out", "checkpoint"), {"least": int, "since": str}),
    "drain-db": (commands.do_drain, ("source", "out", "checkpoint"), {}),
    "pull-storage": (commands.do_copy, ("source", "target"), {}),
    "upload-storage": (commands.do_copy, ("source", "target"), {}),
    "backfill-ranked-segments": (commands.do_backfill, ("raw", "leagues", "out"), {}),
    "diagnose-ranked-segments": (commands.do_diagnose, ("raw", "out"), {}),
    "prepare": (commands.do_prepare, ("raw", "out"), {"days": float}),
    "pretrain-cards": (commands.do_pretrain_cards, ("prepared", "out"), {"size": int}),
    "attach-prior": (commands.do_attach_prior, ("prepared",), {}),
    "train": (commands.do_train, ("prepared", "out"), {"pairs": int, "least": int}),
    "attach-hero-evo-correction": (commands.do_attach_terms, ("model_path", "out"), {"sha256": str, "shrinkage": float}),
    "evaluate": (commands.do_evaluate, ("prepared", "model_path", "out"), {}),
    "evaluate-unseen": (commands.do_evaluate_unseen, ("prepared", "model_path", "out"), {}),
    "evaluate-meta": (commands.do_evaluate_meta, ("prepared", "model_path", "out"), {"least": int}),
    "benchmark": (commands.do_benchmark, ("prepared", "model_path", "out"), {"least": int}),
    "predict": (commands.do_predict, ("model_path", "rows", "out"), {}),
}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="tiltyard")
    out.add_argument("--master")
    sub = out.add_subparsers(dest="command", required=True)
    for name, (_, positional, options) in COMMANDS.items():
        one = sub.add_parser(name)
        for p in positional:
            one.add_argument(p)
        for o, kind in options.items():
            one.add_argument(f"--{o}", type=kind)
    return out


def main(argv: Sequence[str] | None = None, spark=None) -> None:
    args = vars(parser().parse_args(argv))
    name, master = args.pop("command"), args.pop("master")
    spark = spark or session(master=master)
    given = {k: v for k, v in args.items() if v is not None}
    if name == "extract":
        bounds = tuple(int(given.pop(k)) for k in ("lower", "upper", "partitions"))
        commands.do_extract(spark, bounds=bounds, **given)
    else:
        COMMANDS[name][0](spark, **given)


if __name__ == "__main__":
    main()
