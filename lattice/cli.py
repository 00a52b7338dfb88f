"""Command line: python -m lattice.cli ROOT index|add|query|remove|search|info [ARGUMENT]"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lattice.plans.engine import Engine


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="lattice")
    parser.add_argument("root")
    parser.add_argument("command", choices=["index", "add", "query", "remove", "search", "info"])
    parser.add_argument("argument", nargs="?", default="")
    parser.add_argument("-t", "--type", choices=["entities", "chunks", "all"], default="entities")
    a = parser.parse_args(args)
    engine = Engine(SparkSession.builder.appName("lattice").getOrCreate(), a.root)
    if a.command in ("index", "add"):
        print(f"version {getattr(engine, a.command)(a.argument)}")
    elif a.command == "query":
        print(engine.query(a.argument))
    elif a.command == "remove":
        print("removed" if engine.remove(a.argument) else "no such entity")
    elif a.command == "search":
        for kind in ["entities", "chunks"] if a.type == "all" else [a.type]:
            getattr(engine, f"search_{kind}")(a.argument).show(50, truncate=120)
    else:
        for k, v in engine.stats().items():
            print(f"{k}: {v}")


if __name__ == "__main__":
    main()
