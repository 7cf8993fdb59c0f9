from normforge.llm.names import Name, osa, repaired, word_similarity


def test_words():
    assert Name("Orvenvar Vaxondal Power & Light GmbH & Co. KG").words == ["orvenvar", "vaxondal"]
    assert Name("www.orvenvar-vaxondal.test").words == ["orvenvar", "vaxondal"]
    assert Name("GrooPelkdo S.p.A.").words == ["groo", "pelkdo"]
    assert Name("RUDAeHOLM B.V.").words == ["rudaeholm"]
    assert Name("Glimü. Rud. Systaems").words == ["glimu", "rud"] and Name("Glimü. Rud.").short == [True, True]
    assert Name("DrÃ¼usol").words == ["druusol"] and repaired("a​b") == "ab"
    for nobody in (None, "", "  ", "n/a", "unknown", "-", "?", "TBD", "None"):
        assert Name(nobody).words == []
    assert len(Name("x" * 100_000).words) == 1


def test_osa_against_definition():
    import itertools

    def slow(a, b):
        if not a or not b:
            return len(a) + len(b)
        out = min(slow(a[1:], b) + 1, slow(a, b[1:]) + 1, slow(a[1:], b[1:]) + (a[0] != b[0]))
        if len(a) > 1 and len(b) > 1 and a[0] == b[1] and a[1] == b[0]:
            out = min(out, slow(a[2:], b[2:]) + 1)
        return out

    words = ["".join(w) for n in range(4) for w in itertools.product("ab", repeat=n)] + ["abcd", "badc", "acbd"]
    for a in words:
        for b in words:
            for limit in (1, 2, 3):
                assert osa(a, b, limit) == min(slow(a, b), limit + 1)


def test_similarity():
    assert word_similarity("nordpaburn", "nordpaburn") == 1.0
    assert word_similarity("nordpaburn", "nodrpaburn") > 0.9
    assert word_similarity("nord", "nordpaburn", a_short=True) > 0.8
    assert word_similarity("nordpaburn", "tamkarad") == 0.0
