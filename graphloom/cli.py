"""Command line: ``python -m graphloom.cli -d PATH [-q QUERY | -f FILE] [--output table|json|csv] [--import-... FILE]``."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from .errors import GraphError
from .sources.render import RENDERERS
from .store import GraphStore

HELP = ":help  this text\n:stats  node and edge counts\n:clear  clear the screen\n:exit, :quit  leave"


def session() -> SparkSession:
    s = SparkSession.builder.appName("graphloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    return s


def statements(text: str) -> list[str]:
    """Statements of a script, cut at semicolons outside of strings and comments."""
    from .plans.parser import tokens

    out, begin = [], 0
    for kind, got, at in tokens(text):
        if kind == "end" or (kind, got) == ("op", ";"):
            if [t for t in tokens(text[begin:at]) if t[0] != "end"]:
                out.append(text[begin:at].strip())
            begin = at + 1
    return out


def execute(store: GraphStore, text: str, output: str, out=None) -> bool:
    """Run one statement and print its result; whether it worked."""
    try:
        print(RENDERERS[output](store.execute_cypher(text)), file=out)
        return True
    except GraphError as e:
        print(f"Error: {e}", file=out)
        return False


def meta(store: GraphStore, line: str, out=None) -> bool:
    """Run a ``:command``; whether to go on."""
    word = line.split()[0]
    if word in (":exit", ":quit"):
        return False
    if word == ":help":
        print(HELP, file=out)
    elif word == ":stats":
        s = store.stats()
        print(f"Nodes: {s['node_count']}\nEdges: {s['edge_count']}", file=out)
    elif word == ":clear":
        print("\033[2J\033[H", end="", file=out)
    else:
        print(f"Unknown command {word}; :help lists all", file=out)
    return True


def repl(store: GraphStore, output: str, lines=None, out=None) -> None:
    for line in lines or sys.stdin:
        line = line.strip()
        if line.startswith(":"):
            if not meta(store, line, out):
                return
        elif line:
            execute(store, line, output, out)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="graphloom")
    p.add_argument("-d", "--database")
    p.add_argument("-q", "--query")
    p.add_argument("-f", "--file")
    p.add_argument("--output", choices=list(RENDERERS), default="table")
    for kind in ("csv-nodes", "csv-edges", "json-nodes", "json-edges"):
        p.add_argument(f"--import-{kind}")
    a = p.parse_args(argv)
    spark = session()
    try:
        store = GraphStore.open(spark, a.database) if a.database else GraphStore(spark)
    except GraphError:
        store = GraphStore(spark)
    changed = False
    for kind in ("csv_nodes", "json_nodes", "csv_edges", "json_edges"):
        path = getattr(a, f"import_{kind}")
        if path:
            r = getattr(store, f"import_{kind}")(path)
            what = f"{r.nodes_imported} nodes" if kind.endswith("nodes") else f"{r.edges_imported} edges"
            print(f"Imported {what} in {r.duration_ms} ms")
            changed = True
    ok = True
    if a.file:
        with open(a.file, encoding="utf-8") as f:
            ok = all([execute(store, s, a.output) for s in statements(f.read())])
        changed = True
    if a.query:
        ok = execute(store, a.query, a.output) and ok
        changed = True
    if not (a.query or a.file or changed):
        repl(store, a.output)
        changed = True
    if a.database and changed:
        from .sources.store import save

        target = store.graph
        if target.nodes or target.edges:
            # tables are read lazily from the old folder, so the new one is written beside it first
            from .session import stage

            target = type(target)(spark, {k: t.__class__(t.name, stage(t.df, "cli"), t.key, t.labels, t.props, t.extra) for k, t in target.nodes.items()}, {k: t.__class__(t.name, t.type, stage(t.keyed()[0], "cli"), t.src, t.dst, t.props, t.keyed()[1]) for k, t in target.edges.items()})
            save(target, a.database)
    return 0 if ok else 1


if __name__ == "__main__":
    sys.exit(main())
