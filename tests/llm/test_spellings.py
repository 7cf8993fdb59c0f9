import random
from itertools import combinations

from normforge.llm import spellings as S

ORGS = {
    "a": [("Orvenvar Vaxondal", None), ("ORVENVAR VAXONDAL GmbH", ""), ("Orven. Vaxon.", None), ("Vaxondal Orvenvar Drives", None), ("Orvenvra Vaxondal", None), ("orvenvarvaxondal.test", None), ("O. Vaxondal", None), ("OVD", "Orvenvar Vaxondal"), ("Orvenvar Vaxondal", None)],
    "b": [("Orvenvar Tammazan", None), ("Orvenvar Tamazan Inc.", "Orvenvar"), ("", "OrvenvarTammazan")],
    "c": [("Kelresan Grodazen", None), ("KELRESAN GRODAZEN SOLUTIONS", "Kelresan")],
    "": [(None, None), ("n/a", "unknown"), ("", "  ")],
}


def table(spark, rows):
    return spark.createDataFrame([(i, a, b, 1) for i, (a, b) in enumerate(rows)], "vendor_id long, vendor string, vendor_modified string, p int")


def pairs(spark, df):
    return sorted(map(tuple, S.row_pairs(S.clusters(df, "vendor_id", ("vendor", "vendor_modified")), "x", "y").collect()))


def test_links_what_means_one_organisation(spark):
    rows = [(org, r) for org, names in ORGS.items() for r in names]
    want = sorted((i, j) for (i, (a, _)), (j, (b, _)) in combinations(enumerate(rows), 2) if a == b and a)
    df = table(spark, [r for _, r in rows])
    assert pairs(spark, df.repartition(3)) == want


def test_large_buckets_go_by_parts(spark, monkeypatch):
    monkeypatch.setattr(S, "SMALL_BUCKET", 2)
    monkeypatch.setattr(S, "PART", 1)
    monkeypatch.setattr(S, "PART_ROWS", 3)
    test_links_what_means_one_organisation(spark)


def test_links_do_not_depend_on_the_bucket_size(spark, monkeypatch):
    """A heavy spelling that matches two light ones must not hide the link between these."""
    names = ["Orvenvar Vaxondal"] * 9 + ["Orvenvra Vaxondal", "Orvenvar Vaxonda", "Orvnvar Vaxondal", "Orvenvar Vaxndal"]
    _, kept = S.profiles(table(spark, [(n, None) for n in names]), "vendor_id", ("vendor", "vendor_modified"))
    small = sorted(map(tuple, S.links(kept).collect()))
    assert len(small) == 10
    monkeypatch.setattr(S, "SMALL_BUCKET", 2)
    monkeypatch.setattr(S, "PART", 1)
    assert sorted(map(tuple, S.links(kept).collect())) == small


def test_empty(spark):
    assert pairs(spark, table(spark, [(None, None)])) == []
    assert pairs(spark, table(spark, [(None, None)]).limit(0)) == []


def test_bands_reach_the_recall():
    for s, r in ((0.3, 2), (0.5, 4), (0.62, 4)):
        b = S.bands(s, 0.95, r)
        assert 1 - (1 - s**r) ** b >= 0.95 > 1 - (1 - s**r) ** (b - 1)


def test_written_forms_read_back():
    for a, b in [r for names in ORGS.values() for r in names]:
        f = S.forms(a, b)
        assert not f or S.read(S.written(f)) == f


def typo(word, rng):
    at, kind = rng.randrange(1, len(word) - 1), rng.randrange(4)
    return [word[:at] + word[at + 1 :], word[:at] + rng.choice("aeiou") + word[at:], word[:at] + rng.choice("aeiou") + word[at + 1 :], word[: at - 1] + word[at] + word[at - 1] + word[at + 1 :]][kind]


def test_recall_against_all_pairs(spark, monkeypatch):
    """Names of one to eight words, typed with typos, abbreviations and initials, against the verification of all pairs."""
    rng = random.Random(5)
    syllables = "dask pasten kelres grod azen mav crest vik tamm hyd orv lun quen skol irm fal".split()
    vocabulary = [a + b for a in syllables for b in syllables if a != b]
    names = []
    for _ in range(60):
        words = rng.sample(vocabulary, rng.choice([1, 2, 2, 2, 3, 4, 6, 8]))
        names.append(" ".join(words))
        for _ in range(4):
            names.append(" ".join(typo(w, rng) if rng.random() < 0.3 else w for w in rng.sample(words, len(words))))
        if len(words) > 1:
            names += [" ".join(w[:5] + "." for w in words), f"{words[0][0]}. " + " ".join(words[1:]), "".join(words[:2]) if len(words) == 2 else words[0] + " " + words[1]]
    monkeypatch.setattr(S, "SMALL_BUCKET", 4)
    monkeypatch.setattr(S, "PART", 2)
    _, kept = S.profiles(table(spark, [(n, None) for n in names]), "vendor_id", ("vendor", "vendor_modified"))
    found = {(r.p, r.q) for r in S.links(kept).collect()}
    known = [(r.p, S.read(r.form)) for r in kept.collect()]
    want = {(min(p, q), max(p, q)) for (p, f), (q, g) in combinations(known, 2) if S.likeness(f, g) >= S.LINK}
    lost = sorted((dict(known)[p], dict(known)[q]) for p, q in want - found)
    assert found <= want and len(want) > 500, lost[:3]
    assert len(found) >= 0.95 * len(want), lost[::7]


def test_long_names_are_compared_whole(spark):
    alike = "Alpha Bravo Carlos Deltan Echora Foxtrot "
    assert pairs(spark, table(spark, [(alike + "Golfan", None), (alike + "Hotela", None), (alike + "Golfann", None)])) == [(0, 2)]
    assert pairs(spark, table(spark, [("Orvenvar Vaxondal Tammazan", None), ("Orven. Vaxon. Tammaz.", None), ("Glimuyal Vandnajarn", None), ("Glimuy. Vndnaj.", None)])) == [(0, 1), (2, 3)]


def test_very_long_words(spark):
    text = "".join(chr(97 + i * i % 26) for i in range(5_000))
    assert pairs(spark, table(spark, [(text, None), (text + "x", None), (" ".join([text] * 3), None)]))[:1] == [(0, 1)]


def test_members_of_buckets_are_shuffled_once(spark):
    """Small buckets need no sizes and no further exchange; pairs are those of a nested loop, over batches and parts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(h, side, k) for h in range(40) for side in range(3) for k in range(h % 9 + 1)] + [(99, 0, k) for k in range(S.SMALL_BUCKET + 5)] * 2
        rows += rows[:50]
        got = sorted(set(map(tuple, S.met(spark.createDataFrame(rows, "h long, side int, p long").repartition(3), "p").collect())))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(set(combinations(range(S.SMALL_BUCKET + 5), 2)))
    df = S.met(spark.createDataFrame(rows, "h long, side int, p long"), "p")
    df.collect()
    ran = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    assert len([x for x in ran if "REPARTITION_BY_COL" in x and "ReusedExchange" not in x]) == 1


def test_stored_tables_leave_no_shuffle_files(spark, tmp_path):
    from pathlib import Path

    from normforge.session import stored

    root = Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].getPath()).parent
    count = lambda: {f for f in root.rglob("shuffle_*.data")}
    before = count()
    out = stored(spark.range(1000).repartition(5, "id"))
    assert count() <= before and out.count() == 1000
