"""Query registry: a name, a DataFrame builder and, where SQL can say it, its SQL check."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from freshet.plans.testbed import VIEWS, Testbed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _calls(sql: str, name: str, fn: Callable[[list[str]], str]) -> str:
    """Replace ``name(args)`` by ``fn(args)``, innermost first."""
    while m := re.search(rf"\b{name}\(", sql):
        start, depth, args, cut = m.end(), 1, [], m.end()
        i = start
        while depth:
            ch = sql[i]
            depth += (ch == "(") - (ch == ")")
            if (ch == "," and depth == 1) or depth == 0:
                args.append(sql[cut:i])
                cut = i + 1
            i += 1
        sql = sql[: m.start()] + fn(args) + sql[i:]
    return sql


def _round(args: list[str]) -> str:
    s = f"1e{args[1].strip() if len(args) > 1 else 4}"
    return f"(floor(({args[0]}) * {s} + 0.4873) / {s})"


def _sig(args: list[str]) -> str:
    return f"cast(format('{{:.{int(args[1]) - 1 if len(args) > 1 else 5}e}}', cast({args[0]} as double) * (1 + 1e-10::double)) as double)"


def _draw(args: list[str]) -> str:
    key = " || ':' || ".join(f"cast({a.strip()} as varchar)" for a in args)
    return f"cast(('0x' || substr(md5({key}), 1, 8)) as bigint)"


def expand(sql: str, extra: dict[str, str] | None = None) -> str:
    """Expand R() (rounding), SIG() (significant digits), DRAW() (md5 draw) and prepend the views the text names."""
    views = {**VIEWS, **(extra or {})}
    need: list[str] = []

    def visit(text: str) -> None:
        for v in re.findall(r"\bv_\w+\b", text):
            if v in views and v not in need:
                visit(views[v])
                if v not in need:
                    need.append(v)

    visit(sql)
    body = sql.strip()
    ctes = [f"{v} as ({views[v]})" for v in need]
    if body[:5].lower() == "with ":
        ctes.append("")
        body = body[5:]
        head = "with " + ", ".join(ctes)
    else:
        head = ("with " + ", ".join(ctes) + " ") if ctes else ""
    return _calls(_calls(_calls(head + body, "R", _round), "SIG", _sig), "DRAW", _draw)


def query(name: str, sql: str | None = None, views: dict[str, str] | None = None):
    def deco(fn: Callable[[Testbed], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: fn(Testbed(spark, sf_dir))
        if sql is not None:
            ORACLE[name] = expand(sql, views)
        return fn

    return deco
