import hashlib
import os

import pytest
from llm_cases import as_docs, edge_rows
from pyspark.sql import functions as F

from polarity.llm import exact
from polarity.llm.exact import drop_copies, exact_groups


def brute(rows):
    groups = {}
    for i, t, _ in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    for i, t, _ in rows:
        ids = groups[t or ""]
        out.append((i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("digest", [None, lambda t: F.unhex(F.substring(F.sha2(t, 256), 1, 1).cast("string"))])
def test_groups_equal_brute_force(edge, digest):
    got = exact_groups(edge, digest=digest).collect()
    assert sorted([(r.id, r.keep_id, r.group_size, r.sha256) for r in got], key=repr) == brute(edge_rows())
    stay = [r for r in got if r.kept]
    assert len(stay) == len({r.sha256 for r in got})            # one row of each group, repeated ids or not
    assert all(r.id == r.keep_id for r in stay)


def test_many_batches_give_the_same(spark, edge, tmp):
    edge.repartition(6).write.parquet(f"{tmp}/docs")
    docs = spark.read.parquet(f"{tmp}/docs")
    one, many = (sorted(exact_groups(docs, max_bytes_per_trigger=b).drop("file", "row").collect(), key=repr) for b in (1 << 40, 1))
    assert one == many


def test_drop_copies(edge, nothing):
    left = drop_copies(edge)
    assert left.columns == edge.columns
    assert sorted(r.text or "" for r in left.collect()) == sorted({t or "" for _, t, _ in edge_rows()})
    assert drop_copies(nothing).count() == exact_groups(nothing).count() == 0
    assert {r.id for r in left.collect()} == {"own id"}


def test_state_decides_later_arrivals(spark, monkeypatch):
    """By default the arrivals come in several micro-batches; a text's copies are spread over them."""
    commits = []

    def remove(session, path, real=exact.remove_path):
        folder = os.path.join(path.removeprefix("file:"), "commits")
        if os.path.isdir(folder):
            commits.append(sum(name.isdigit() for name in os.listdir(folder)))
        return real(session, path)

    monkeypatch.setattr(exact, "remove_path", remove)
    rows = [(i, f"text {i % 50}", "s") for i in range(400)]
    got = exact.exact_groups(as_docs(spark, rows).repartition(8)).collect()
    assert commits and commits[0] > 1
    assert sorted((r.id, r.keep_id, r.group_size, r.kept) for r in got) == [(i, 350 + i % 50, 8, i >= 350) for i in range(400)]
