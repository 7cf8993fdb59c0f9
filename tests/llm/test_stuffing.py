import random
import re

from normforge.llm import stuffing as S

WORDS = ["spare parts", "best price", "in stock", "wiring diagram", "same day shipping", "firmware download", "plc", "gateway", "buy online", "warranty"]
STORY = "The night shift lost the label of the cabinet before anyone noticed. A restart clears the symptom for about an hour, but the fault came back on Monday. Older boards cannot load the new build, so the team kept a spare. "
rng = random.Random(5)


def pages():
    out = []
    for i in range(40):
        host = f"h{i % 12}.example"
        kind = i % 4
        keys = [rng.choice(WORDS) for _ in range(40)]
        spam = [", ".join(keys), "\n".join(f"https://{host}/{k.replace(' ', '-')}" for k in keys), " ".join("#" + k.replace(" ", "_") for k in keys), "A short heading\n" + " new ".join(keys)][kind]
        out.append((i, spam, host, True))
        out.append((1000 + i, STORY * 3 + "Tags: spare parts, in stock, plc. See https://a.example/1", host, False))
        out.append((2000 + i, STORY + "\n- Robo 200 ABC-1234-X, fixed\n- Robo 200 ABC-1235-X, all builds\n- Robo 200 ABC-1236-X, fixed\n" + STORY, None, False))
    return [*out, (9000, None, "h", False), (9001, "", "h", False), (9002, "...", "h", False), (9003, STORY * 400, "h", False), (9004, ", ".join(WORDS * 500), "h", True)]


def run(spark, rows):
    return spark.createDataFrame([(i, t, h, "x") for i, t, h, _ in rows], "doc_id long, text string, site string, phrase string").repartition(4)


def test_flags_only_stuffed_pages(spark):
    rows = pages()
    got = {r.doc_id for r in S.stuffed_pages(run(spark, rows)).collect()}
    assert got == {i for i, _, _, spam in rows if spam}


def test_too_many_phrases_to_broadcast(spark, monkeypatch):
    rows = pages()
    monkeypatch.setattr(S, "BROADCAST_PHRASES", 2)
    assert {r.doc_id for r in S.stuffed_pages(run(spark, rows)).collect()} == {i for i, _, _, spam in rows if spam}


def test_gate_loses_nothing():
    rows = [t for _, t, _, _ in pages() if t]
    known = frozenset(WORDS) | {w.replace(" ", "") for w in WORDS}
    gate, phrases = S.Gate(known), S.Phrases(known)
    for t in rows:
        if not gate.passes(t):
            assert S.evidence(t, phrases)[0] == 0


def test_phrases_may_hold_digits():
    items = S.list_items("robo 500 quote, power supply 24v, plc, 500, hmi panel, in stock, best price")
    assert items == {"robo 500 quote", "power supply 24v", "plc", "hmi panel", "in stock", "best price"}


def test_more_hosts_hide_nothing(spark):
    """The same pages beside ten times the hosts and pages: what was replicated stays so."""
    rows = pages()
    many = rows + [(10_000 + 100 * k + i, STORY + f"Unit {k} {i} is fine.", f"other{k}.example", False) for k in range(120) for i in range(5)]
    assert {r.doc_id for r in S.stuffed_pages(run(spark, many)).collect()} == {i for i, _, _, spam in rows if spam}


def test_phrases_of_few_hosts_are_no_evidence(spark):
    rows = [(i, ", ".join(WORDS), f"h{i % (S.HOSTS - 1)}", False) for i in range(20)]
    assert S.replicated_phrases(run(spark, rows)).count() == 0
    assert S.replicated_phrases(run(spark, rows + [(99, ", ".join(WORDS), "one more", False)])).count() == len(WORDS)


def test_empty(spark):
    assert S.stuffed_pages(run(spark, pages()).limit(0)).count() == 0


def test_shingles_of_running_text_count(spark):
    """A phrase that two hosts list and four more hold in their sentences is replicated; a word of most sentences is none."""
    rows = [(i, ", ".join([*WORDS, "cabinet"]), f"list{i}", True) for i in range(2)]
    rows += [(10 + i, f"Number {i} has spare parts in the cabinet.", f"text{i}", False) for i in range(4)]
    rows += [(20 + i, STORY, f"story{i}", False) for i in range(9)]
    assert {r.phrase for r in S.replicated_phrases(run(spark, rows)).collect()} == {"spare parts"}


def test_shingles_of_long_items_count(spark):
    rows = [(i, ", ".join(f"ask{k}{i} for {w} with tax{k}{i} and more{k}{i}" for k, w in enumerate(WORDS)) + "\n" + ", ".join(f"tag{k}{i}" for k in range(S.RUN)), f"h{i}", True) for i in range(S.HOSTS)]
    assert {f"for {w} with" for w in WORDS if len(w.split()) < 3} <= {r.phrase for r in S.replicated_phrases(run(spark, rows)).collect()}


def brute_phrases(rows):
    """Every shingle of every page, counted one by one."""
    on = {}
    for i, t, h, _ in rows:
        page = (i, h or "", bool(t) and S.listed(t))
        for piece in re.split(r"[\n,|>/*•★;·»#\[\]()\t<\x01]|(?<=\s)-(?=\s)|[.!?:](?=\s)", S.plain_of(S.cleaned(t or "").lower()) + "\n"):
            words = S.words_of(piece)
            for n in range(1, S.LONGEST + 1):
                for k in range(len(words) - n + 1):
                    on.setdefault(" ".join(words[k : k + n]), set()).add(page)
    kept = {p: {i for i, *_ in x} for p, x in on.items() if len({h for _, h, _ in x}) >= S.HOSTS and sum(of_list for *_, of_list in x) >= S.LISTED * len(x) and len(p) > 2 and any(c.isalpha() for c in p)}
    shorter = {(p, q) for q in kept if " " in q for p in (q.split(" ", 1)[1], q.rsplit(" ", 1)[0])}
    return set(kept) - {p for p, q in shorter if kept.get(p) == kept[q]}


def test_phrases_are_those_of_all_shingles(spark):
    odd = ["Robo-500 C++ d'été v1.2.3, a - b, x.. y! ½ ② İstanbul ß", "\U0001f600 plc \U0001d54f plc", "see https://a.example/x?y=1 and www.b.example now", "only 12.50 spare parts (12) ★", "<b>spare parts</b>\r\n&amp; plc"]
    rows = [(i, t, h, False) for i, t, h, _ in pages() if t] + [(5000 + 10 * i + k, f"{t}, {', '.join(WORDS[k:])}", f"odd{k}", True) for k in range(7) for i, t in enumerate(odd)]
    brute = brute_phrases(rows)
    assert len(brute) > 10
    assert {r.phrase for r in S.replicated_phrases(run(spark, rows)).collect()} == brute


def test_links_and_prices_are_found_as_in_the_whole_text():
    texts = [t.lower() for _, t, _, _ in pages() if t] + ["only 12.50 or nur 9,99 or € 3.20, www.1.2 x.example/a b c.example\td.example", "(12) ★ www.a.example", "v1.25 from here", "a.b.example"]
    for t in texts:
        url = S.URL.sub(S.LINK, t) if S.DOT.search(t) else t
        assert S.plain_of(t) == (S.PRICE.sub(S.LINK, url) if S.OFFER.search(url) else url)


def test_phrases_that_overlap_cover_all_their_words():
    assert S.marks(["new", "best", "price", "plc"], S.Phrases({"new best price", "best price plc"})) == b"\1\1\1\1"
