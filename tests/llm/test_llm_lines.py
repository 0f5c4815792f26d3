import random

import pytest
from llm_cases import as_docs, edge_rows, prose, shingles_of

from polarity.llm.lines import drop_later_lines, similar_lines


def brute(rows, percent=75):
    """(id, line, tokens, copies, whether an earlier class is similar, removed) of rows with distinct ids."""
    lines = [((i is not None, i or 0, k), i, k, shingles_of(x)) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n"))]
    lines = [x for x in lines if x[3]]
    sets = {}
    for place, _, _, s in lines:
        sets.setdefault(s, []).append(place)
    earliest = {s: min([min(sets[b]) for b in sets if b != s and 100 * len(s & b) >= percent * len(s | b)], default=min(sets[s])) for s in sets}
    return sorted(((i, k, len(s), len(sets[s]), earliest[s] < min(sets[s]), min(earliest[s], min(sets[s])) < place) for place, i, k, s in lines), key=repr)


def result(df):
    return sorted([(r.id, r.line, r.n_tokens, r.n_copies, r.earlier_class is not None, r.removed) for r in df.collect()], key=repr)


def check_links(df, rows, percent=75):
    """Every earlier_class holds a line similar to this one and before it."""
    text = {(i, k): shingles_of(x) for i, t, *_ in rows for k, x in enumerate((t or "").split("\n"))}
    found = df.collect()
    first = {}
    for r in found:
        place = (r.id is not None, r.id or 0, r.line)
        first[r.class_id] = min(first.get(r.class_id, (place, r.id, r.line)), (place, r.id, r.line), key=lambda x: x[0])
    for r in found:
        if r.earlier_class is not None:
            place, i, k = first[r.earlier_class]
            a, b = text[i, k], text[r.id, r.line]
            assert place < first[r.class_id][0] and a != b and 100 * len(a & b) >= percent * len(a | b)


def corpus(seed):
    """Lines that repeat exactly, nearly, and only in part; one passage that many lines share."""
    rng, passage = random.Random(seed), prose(77, 30)
    base = [prose(k, rng.randint(1, 40)) for k in range(25)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randint(0, 6)):
            w = rng.choice(base).split()
            kind = rng.random()
            if kind < 0.5:
                for _ in range(rng.randint(1, 3)):
                    w[rng.randrange(len(w))] = f"n{rng.randrange(30)}"
            elif kind < 0.7:
                w = passage.split() + [f"u{rng.randrange(10**6)}" for _ in range(rng.randint(0, 25))]
            lines.append(rng.choice([" ", "  ", "\t"]).join(w) + rng.choice(["", " ", "\r"]))
        rows.append((i, "\n".join(lines), "s"))
    return rows


def test_edge_cases(edge, nothing):
    rows = edge_rows()
    twice = [r for r in result(similar_lines(edge)) if r[0] == 8]
    assert [r[1:] for r in twice] in ([(0, 1, 3, False, False), (0, 1, 3, False, True)], [(0, 1, 3, False, True), (0, 1, 3, False, False)])
    assert [r for r in result(similar_lines(edge)) if r[0] != 8] == [r for r in brute(rows) if r[0] != 8]
    assert similar_lines(nothing).count() == drop_later_lines(nothing).count() == 0


@pytest.mark.parametrize("seed", range(2))
def test_equal_to_brute_force(spark, seed):
    rows = corpus(seed)
    got = similar_lines(as_docs(spark, rows))
    assert result(got) == brute(rows)
    check_links(got, rows)
    assert any(r[4] for r in brute(rows))


def test_family_of_near_lines(spark):
    """Lines that differ in a few words each: later rounds find what the earliest classes of their tokens do not."""
    rng = random.Random(3)
    base = prose(5, 60).split()
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(w[rng.randint(0, 6):]), "s"))
    got = similar_lines(as_docs(spark, rows))
    assert result(got) == brute(rows)
    check_links(got, rows)


def test_exploded_and_joined_frames(spark, tmp_path):
    """A frame that repeats the rows of a file: every row is a document of its own."""
    from pyspark.sql import functions as F

    from polarity.llm.exact import drop_copies
    from polarity.llm.near import keep_one
    rows = [(i, prose(i % 4, 30), "s") for i in range(6)]
    as_docs(spark, rows).select("doc_id", "text", "source").write.parquet(str(tmp_path / "d"))
    one = spark.read.parquet(str(tmp_path / "d"))
    twice = [one.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2)))), one.join(spark.range(2).withColumnRenamed("id", "k"))]
    for frame in twice:
        assert similar_lines(frame).filter("NOT removed").count() == 4
        assert drop_copies(frame).count() == 4
        assert keep_one(frame).select("doc_id").distinct().count() == 4


def test_removal(spark):
    rows = corpus(5) + [(900, None, "s"), (901, "", "s"), (902, "\n\n", "s")]
    docs = as_docs(spark, rows)
    gone = {(i, k) for i, k, *_, removed in brute(rows) if removed}
    want = {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t, _ in rows}
    left = drop_later_lines(docs)
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == want


def test_every_link_is_counted(spark):
    """A family of near lines: a class is linked with all similar classes, earlier and later ones, not with one of them."""
    rng = random.Random(4)
    base = prose(6, 60).split()
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = f"n{rng.randrange(9)}"
        rows.append((i, " ".join(w[rng.randint(0, 6):]), "s"))
    got = similar_lines(as_docs(spark, rows)).collect()
    sets = {r.class_id: shingles_of(rows[r.id][1]) for r in got}
    want = {c: sorted(d for d in sets if d != c and 100 * len(sets[c] & sets[d]) >= 75 * len(sets[c] | sets[d])) for c in sets}
    assert {r.class_id: r.n_links for r in got} == {c: len(x) for c, x in want.items()}
    assert {r.class_id: r.earlier_class for r in got} == {c: min([d for d in x if d < c], default=None) for c, x in want.items()}
    assert max(len(x) for x in want.values()) > 5
