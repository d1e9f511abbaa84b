"""Paths between inputs and calls against a version that walks the lines, on random files, changes and chunks."""

import random

import pytest

from siftlake.operators import imports, rules

LINES = ("v = request.args.get('x')", "cursor.execute(v)", "a = b", "c = escape(d)", "e += quote(f)", "pass", "print(a)", "cursor.execute(q)  # siftlake-ignore: CWE-89 reason: test", "w = input('?')")
SCHEMA = "pr_id int, path string, language string, line_no int, text string, changed boolean"


def walked(text, changed):
    """(sink line, suppressed, source line, edges, first sanitizer's line) of one file and one set of changed lines."""
    edges = {i: t for i, t in text.items() if "=" in t.split("#")[0]}
    sinks = [i for i in sorted(changed) if "cursor.execute" in text.get(i, "")]
    sources = [i for i, t in text.items() if ("request.args" in t or "input(" in t) and any(abs(i - c) <= 50 for c in changed)] or [0]
    out = set()
    for sink in sinks:
        for source in sources:
            inside = [i for i in edges if max(1, min(sink, source)) <= i <= max(sink, source)]
            clean = [i for i in inside if "escape" in edges[i] or "quote" in edges[i]]
            note = any("siftlake-ignore" in text.get(i, "") for i in (sink, sink - 1))
            out.add((sink, note, source, len(inside), min(clean, default=None)))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_paths_by_file_and_by_chunk(spark, seed):
    pick = random.Random(seed)
    files, rows, changes = {}, [], []
    for pr in range(6):
        for path in ("a.py", "b.py"):
            text = {i: pick.choices(LINES, [1, 2, 4, 1, 1, 30, 5, 1, 1])[0] for i in range(1, pick.choice([40, 400]))}
            chunk_of = {i: pick.choice([None, None, i // 60, 7]) for i in text}
            files[pr, path] = text, chunk_of
            rows += [(pr, path, "python", i, t, chunk_of[i] is not None) for i, t in text.items()]
            changes += [(pr, c, path, i) for i, c in chunk_of.items() if c is not None]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    changed = spark.createDataFrame(changes + changes[:9], "pr_id int, chunk int, path string, line_no int")
    line = lambda r: int(r.sanitizer.rsplit(" ", 1)[1]) if r.sanitizer else None
    whole = rules.taint_paths(rules.sinks(df), rules.sources(df), rules.edges(df)).collect()
    chunked = rules.taint_paths(rules.chunk_sinks(df, changed), rules.chunk_sources(df, changed), rules.edges(df)).collect()
    assert all(r.sanitized == (r.sanitizer is not None) for r in [*whole, *chunked])
    for (pr, path), (text, chunk_of) in files.items():
        got = [(r.sink_line, r.suppressed, r.source_line, r.edges, line(r)) for r in whole if (r.pr_id, r.path) == (pr, path)]
        assert len(got) == len(set(got)) and set(got) == walked(text, {i for i, c in chunk_of.items() if c is not None})
        for chunk in {c for c in chunk_of.values() if c is not None}:
            got = [(r.sink_line, r.suppressed, r.source_line, r.edges, line(r)) for r in chunked if (r.pr_id, r.chunk, r.path) == (pr, chunk, path)]
            assert len(got) == len(set(got)) and set(got) == walked(text, {i for i, c in chunk_of.items() if c == chunk})


def test_no_join_of_pairs_with_assignments(spark):
    """The plan joins pairs with look-ups on a line, never with the assignments of a file."""
    df = spark.createDataFrame([(1, "a.py", "python", 1, "x = 1", True)], SCHEMA)
    plan = rules.taint_paths(rules.sinks(df), rules.sources(df), rules.edges(df))._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.split("\n") if "Join " in x]
    assert joins and not any("<=" in x or ">=" in x for x in joins)


def test_statements_of_long_files_stay_short(spark):
    """Only what belongs to a statement is gathered, however long the file is."""
    rows = [(1, "a.js", i + 1, t) for i, t in enumerate(["const a = {", *["  x: 1,"] * 50, "}; call()", *["y = 2"] * 5000, "import {", "  b", "} from './c'", *["z('q')"] * 3000])]
    got = imports.statements(spark.createDataFrame(rows, "pr_id int, path string, line_no int, text string")).collect()
    assert sorted((r.line_no, len(r.text.split("\n"))) for r in got) == [(1, 52), (5053, 3)]
