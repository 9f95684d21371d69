"""Command line: run a program of facts and rules, or pass s-expressions through a template.

    spark-submit atomweave/cli.py run program.sexp --steps 1000 --out facts.sexp --aux more.sexp --timing
    python -m atomweave.cli convert in.sexp out.sexp --pattern '(row $k $v)' --template '(kv $v $k)'
"""

from __future__ import annotations

import argparse
import sys
import time
from pathlib import Path

from .sources.loaders import convert
from .space import Space


def run_program(path: str, steps: int = 10**9, out: str | None = None, aux: tuple[str, ...] = (), timing: bool = False, spark=None) -> Space:
    """Loads a program and further files, runs it and writes or returns what is left."""
    s = Space(spark, timing=timing)
    for p in (*aux, path):
        s.add(Path(p).read_text())
    began = time.monotonic()
    done = s.run(steps)
    if timing:
        print(f"{done} steps in {time.monotonic() - began:.3f} s, {s.count()} atoms", file=sys.stderr)
    if out is not None:
        Path(out).write_text("".join(x + "\n" for x in s.dump()))
    return s


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="atomweave", description=__doc__)
    sub = p.add_subparsers(dest="what", required=True)
    r = sub.add_parser("run")
    r.add_argument("path")
    r.add_argument("--steps", type=int, default=10**9)
    r.add_argument("--out")
    r.add_argument("--aux", action="append", default=[])
    r.add_argument("--timing", action="store_true")
    c = sub.add_parser("convert")
    c.add_argument("source")
    c.add_argument("target")
    c.add_argument("--pattern", default="$x")
    c.add_argument("--template", default="$x")
    a = p.parse_args(args)
    if a.what == "run":
        s = run_program(a.path, a.steps, a.out, tuple(a.aux), a.timing)
        if a.out is None:
            print("\n".join(s.dump()))
    else:
        for name in (a.source, a.target):
            if Path(name).suffix not in (".sexp", ".txt"):
                p.error(f"{name}: only s-expressions are converted")
        Path(a.target).write_text(convert(Path(a.source).read_text(), a.pattern, a.template) + "\n")
    return 0


if __name__ == "__main__":
    sys.exit(main())
