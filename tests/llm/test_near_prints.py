"""The SimHash step of the near_dedup stage."""

import random

from test_similar import kept_of

from driftline.llm import similar, simhash, stages


def test_near_copies_meet_by_their_fingerprints(spark, monkeypatch):
    """The stage's first step is the five-word SimHash through op5's cells and pivot tables."""
    rng, seen = random.Random(5), []
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for base in range(8):
        text = [word() for _ in range(1500)]
        rows += [(10 * base, " ".join(text)), (10 * base + 1, " ".join([*text[:-1], word()]))]
    rows += [(100 + i, t) for i, t in enumerate([" ".join(word() for _ in range(40)), "", None, "one"])]
    whole = simhash.links
    monkeypatch.setattr(simhash, "links", lambda known, *a, **b: seen.append(
        (known, known.collect(), found := whole(known, *a, **b), found.collect())) or found)
    got = sorted(r.doc_id for r in stages.near_dedup(
        spark, spark.createDataFrame(rows, "doc_id long, text string"), "").select("doc_id").collect())
    assert got == kept_of(rows)

    ((_, prints, _, edges),) = seen
    sets = {similar.key_of(x): x for x in (similar.shingles((t or "").encode()) for _, t in rows)}
    assert {r.key: r.fp for r in prints} == {
        k: simhash.signed(simhash.majority(x)) for k, x in sets.items() if len(x)}
    keys = [similar.key_of(similar.shingles(t.encode())) for _, t in rows[:16]]
    assert {(min(x), max(x)) for x in zip(keys[::2], keys[1::2])} <= {
        (min(r.a, r.b), max(r.a, r.b)) for r in edges}
