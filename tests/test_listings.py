"""Lookups in listings: by equality, and without a table that the driver would hold."""

import itertools
import re

from quire.operators import discover, repair


def nodes(plan):
    """(name, number of keys if it joins by keys) of every node of an executed plan."""
    name = plan.nodeName()
    if name == "AdaptiveSparkPlan":
        below = [plan.executedPlan()]
    elif name.endswith("QueryStage"):
        below = [plan.plan()]
    else:
        below = [plan.children().apply(i) for i in range(plan.children().size())]
    yield name, plan.leftKeys().size() if name in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") else None
    for b in below:
        yield from nodes(b)


def run(df):
    return df.collect(), list(nodes(df._jdf.queryExecution().executedPlan()))


def found_log(files, folder, source):
    """The five rules of A6, one by one."""
    parts = [(f, *f.rsplit("/", 1)) for f in files if f.lower().endswith(".jsonl")]
    inside = [(f, at.rsplit("/", 1)[1], name) for f, at, name in parts if at.rsplit("/", 1)[0] == folder]
    own = [(f, name) for f, own, name in inside if own == source]
    cut = [f for f, own, _ in inside if re.search("-[0-9a-f]{8}$", own) and source.startswith(own[:-9])]
    rules = [[f for f, at, name in parts if at == folder and name == f"{source}.jsonl"], [f for f, name in own if name == f"{source}.jsonl"], [f for f, name in own if name == f"{source}_transcription.jsonl"], [f for f, _ in own], cut]
    return next((min(r) for r in rules if r), None)


def test_artifacts_rules(spark):
    names = ["a", "ab", "abc", "abd-x", "b", "b-0123abcd", "c.d"]
    files = [f"/m/{n}{tail}" for n, tail in itertools.product(names[1:5], ("-89abcdef/z.jsonl", "-89abcdef/y.jsonl"))]
    files += ["/m/a.jsonl", "/m/a/a.jsonl", "/m/ab/ab_transcription.jsonl", "/m/ab/aa.jsonl", "/m/b-0123abcd/q.JSONL", "/n/-01234567/e.jsonl", "/n/c.d/r.jsonl", "/n/c.d.JSONL", "/n/x-0123abcg/w.jsonl", "/m/c.d/notes.txt"]
    sources = [(f, s) for f in ("/m", "/n", "/o") for s in [*names, "abcdefgh", "x"]]
    got = discover.artifacts(spark.createDataFrame([(f,) for f in files], "path string"), spark.createDataFrame(sources, "folder string, source string")).collect()
    assert {(r.folder, r.source): r.path for r in got} == {(f, s): p for f, s in sources if (p := found_log(files, f, s))}


def test_artifacts_pair_no_source_with_all_files_of_its_folder(spark):
    n = 300
    files = [(f"/m/s{i:06d}{tail}",) for i in range(n) for tail in (("/x.jsonl", "-0123abcd/x.jsonl") if i % 2 else ("-0123abcd/x.jsonl",))]
    rows, plan = run(discover.artifacts(spark.createDataFrame(files, "path string"), spark.createDataFrame([("/m", f"s{i:06d}") for i in range(n)], "folder string, source string")))
    assert {(r.source, r.path) for r in rows} == {(f"s{i:06d}", f"/m/s{i:06d}{'/x.jsonl' if i % 2 else '-0123abcd/x.jsonl'}") for i in range(n)}
    keys = [n for _, n in plan if n is not None]
    assert keys and min(keys) > 1  # by folder and name; the folder alone is one key of all rows


def test_found_images_broadcast_no_listing(spark):
    pages = spark.createDataFrame([(i, ["/gone.png", f"/d{i}/a.tif", "/x.png"] if i % 3 else ["/gone.png"]) for i in range(200)], "id int, candidates array<string>")
    files = spark.createDataFrame([(f"/d{i}/a.tif",) for i in range(0, 200, 2)] + [("/x.png",)], "path string")
    rows, plan = run(repair.found_images(pages, files, ["id"]))
    assert {(r.id, r.image_path) for r in rows} == {(i, None if i % 3 == 0 else "/x.png" if i % 2 else f"/d{i}/a.tif") for i in range(200)}
    assert not [name for name, _ in plan if "Broadcast" in name]
