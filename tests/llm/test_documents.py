import random
from collections import Counter

import pyarrow as pa
import pytest
from tests.conftest import rows

from epochal.llm import leaks, mixing, reading
from epochal.llm.automaton import Automaton
from epochal.llm.words import placed_words, words

PASSAGE = "When a late frost reached Fenlum, 155 weavers carried the spools of wire across a walled valley toward Velbriwen, and every household received a lantern before the census."
OTHER = "By the time 974 schoolchildren arrived from Thonor, the tide recorder had already donated the painted tiles, after a bitter quarrel over wages with the guild of carters."
ASK = "Read the short passage below and choose the one statement that agrees with it best of all."
DOC = "doc_id long, text string, item_id string"


def items(spark, *extra):
    held = [(1, PASSAGE), (2, PASSAGE), (3, OTHER), *extra]
    plain = [(100 + i, f"{w} {w}{i} one two three four five six seven eight nine ten eleven{i} twelve{i}") for i, w in enumerate("abcdefghijkl")]
    return spark.createDataFrame([(i, "s", f"{ASK}\n\n{t}\n\nQuestion: who?") for i, t in held + plain] + [(999, "s", None), (998, "s", "")], "item_id long, suite string, text string")


def found(spark, *texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], DOC)
    return rows(leaks.leaked_pairs(docs, items(spark)))


def test_longest_matches_are_brute_force():
    rng = random.Random(1)
    passages = [[rng.randint(0, 3) for _ in range(rng.randint(1, 30))] for _ in range(8)]
    text = [rng.randint(-1, 4) for _ in range(200)]
    automaton = Automaton(passages)
    runs = {tuple(p[a:b]) for p in passages for a in range(len(p)) for b in range(a + 1, len(p) + 1)}
    for at, (n, state) in enumerate(automaton.longest(text)):
        best = max((k for k in range(at + 2) if k == 0 or tuple(text[at + 1 - k : at + 1]) in runs))
        assert n == best
        if n:
            own = text[at + 1 - n : at + 1]
            want = {(i, e) for i, p in enumerate(passages) for e in range(n - 1, len(p)) if p[e + 1 - n : e + 1] == own}
            assert set(automaton.places(state)) == want


@pytest.mark.parametrize("text", ["", "plain words", "A <b>bold</b>&nbsp;word &amp; more", "fest-\n> ival", "ｗｉｄｅ Straße ﬁne é s­oft ze​ro", "x<y and y>z", "a-\nb-\nc"])
def test_words_and_places_agree(text):
    spelled, places = placed_words(text)
    assert spelled == words(text) and all(0 <= a < b <= len(text) for a, b in places)


def test_forms(spark):
    assert words("fest-\n> ival ｗｉｄｅ so­ft <b>x</b>&nbsp;Y") == ["festival", "wide", "soft", "x", "y"]
    w = PASSAGE.split()
    marked = " ".join(f"<i>{x}</i>" for x in w)
    altered = PASSAGE.replace("spools", "rolls").replace("lantern", "lamp")
    assert found(spark, "Bought it. " + PASSAGE.upper() + " Nice.", marked, altered, " ".join(w[:12]), " ".join(w[3:9]), ASK + " Question: who?", None, "", "x " * 50_000 + PASSAGE) == [(i, k) for i in (0, 1, 2, 3, 8) for k in (1, 2)]


def test_short_altered_pieces(spark):
    w = PASSAGE.split()
    one, two = w[4:16], w[4:22]
    one[6] = two[5] = two[11] = "altered"
    beside = [*w[:12], "not", "one", "word", *w[15:18], "other", "others", *w[20:22]]  # an unaltered run beside altered words
    assert found(spark, *(" ".join(["pears", *x, "plums"]) for x in (one, two, beside, w[4:9] + ["altered"] + w[10:14]))) == [(i, k) for i in (0, 1, 2) for k in (1, 2)]


def test_short_altered_pieces_of_common_wording():
    start = [f"w{k}" for k in range(14)]
    held = [(i, f"{ASK}\n\n" + " ".join([*start[:6], f"name{i}", *start[7:], *(f"own{i}x{k}" for k in range(10))])) for i in range(12)]
    index = leaks.build_index(held, leaks.Rules())
    got = [leaks.leaks_in(index, index.codes([*start[:6], x, *start[7:]]), leaks.Rules()) for x in ("unknown", "name3")]
    assert got[0] == [] and [index.items[x.passage] for x in got[1]] == [[3]]


def test_several_items_and_repeats(spark):
    assert found(spark, PASSAGE + " and " + OTHER, OTHER, OTHER) == [(0, 1), (0, 2), (0, 3), (1, 3), (2, 3)]


def near(rng, base, k):
    """A passage with k words altered."""
    out = list(base)
    for at in rng.sample(range(len(base)), k):
        out[at] = f"alt{rng.randint(0, 50)}"
    return out


def test_sharding_changes_nothing(spark):
    """Near-equal passages, altered words, and one automaton or one per passage."""
    rng = random.Random(6)
    base = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(14, 40))] for _ in range(12)]
    held = [(10 * i + k, f"{ASK}\n\n" + " ".join(p if k == 0 else near(rng, p, k))) for i, p in enumerate(base) for k in (0, 1, 2, 5)]
    docs = []
    for n in range(60):
        p = rng.choice(held)[1].split("\n\n")[1].split()
        a = rng.randint(0, len(p) - 12)
        docs.append((n, " ".join(["pears"] * 5 + near(rng, p[a : a + rng.randint(12, 40)], min(2, n % 4)) + ["plums"] + rng.choice(base)[:13]), ""))
    df = spark.createDataFrame(docs, DOC)
    suite = spark.createDataFrame([(i, "s", t) for i, t in held], "item_id long, suite string, text string")
    pairs = [rows(leaks.find_leaks(df, suite, shard_words=size)) for size in (10, 300, 200_000)]
    assert pairs[0] == pairs[1] == pairs[2] and len(pairs[0]) > 60


def test_near_equal_passages_are_settled_whatever_the_automaton(spark):
    w = PASSAGE.split()
    other = [*w[:10], "seven", *w[11:]]
    suite = spark.createDataFrame([(1, "s", PASSAGE), (2, "s", " ".join(other)), (3, "s", OTHER)], "item_id long, suite string, text string")
    df = spark.createDataFrame([(0, "pears " + " ".join(other[4:17]) + " plums", "")], DOC)
    for size in (10, 200_000):
        assert [r[1] for r in rows(leaks.leaked_pairs(df, suite, shard_words=size))] == [2]


@pytest.mark.parametrize("n", [3, 11, 30])
def test_any_number_of_items_shares_a_passage(n):
    held = [(i, f"{ASK}\n\n{PASSAGE}\n\nQuestion: what is number {i} of them all?") for i in range(n)]
    held += [(100 + i, f"{ASK}\n\n" + " ".join(f"p{i}x{k}" for k in range(40))) for i in range(5)]
    index = leaks.build_index(held, leaks.Rules())
    got = leaks.leaks_in(index, index.codes(words(f"pears {PASSAGE} plums {ASK}")), leaks.Rules())
    assert [index.items[x.passage] for x in got] == [list(range(n))]


def test_every_paragraph_is_a_passage():
    second = " ".join(f"second{k}" for k in range(14))
    for shared in (1, 12):  # also when many items share both paragraphs
        held = [(i, f"{ASK}\n\n{PASSAGE}\n \n{second}\n\nIs statement number {i} of the ones given below right or wrong, after all that was said?") for i in range(shared)]
        held += [(100 + i, f"{ASK}\n\n" + " ".join(f"p{i}x{k}" for k in range(40))) for i in range(5)]
        index = leaks.build_index(held, leaks.Rules())
        for text, n in ((second, 1), (PASSAGE, 1), (ASK, 0), (f"{PASSAGE} and {second}", 2), ("Is statement number 0 of the ones given below right or wrong, after all that was said?", 0)):
            got = leaks.leaks_in(index, index.codes(words(text)), leaks.Rules())
            assert len(got) == n and all(index.items[x.passage] == list(range(shared)) for x in got)


def test_candidates_lose_nothing():
    """The batch path against the walk of each text alone."""
    rng = random.Random(8)
    index = leaks.build_index([(1, PASSAGE), (2, OTHER)], leaks.Rules())
    texts = ["", "x"] + [" ".join(rng.choice((PASSAGE, OTHER)).split()[a : a + rng.randint(1, 20)] + ["é", "<b>"] + rng.choice((PASSAGE, OTHER)).split()[: rng.randint(0, 14)]) for a in [rng.randint(0, 15) for _ in range(200)]]
    got = leaks.leaks_of(index, [lambda s=s: s for s in index.shards], pa.array(texts), leaks.Rules())
    want = {k: held for k, t in enumerate(texts) if (held := leaks.leaks_in(index, index.codes(words(t)), leaks.Rules()))}
    assert {k: [x for x, _, _ in v] for k, v in got.items()} == want and len(want) > 50


def test_removal(spark):
    filler = " ".join(f"filler{i}" for i in range(80))
    docs = spark.createDataFrame([(1, f"{filler} {PASSAGE} tail", "a"), (2, PASSAGE, "b"), (3, filler, "c"), (4, None, "d")], DOC)
    got = {r[0]: r for r in rows(leaks.remove_leaks(docs, items(spark)))}
    assert set(got) == {1, 3, 4} and got[3][1:] == (filler, "c", 0)
    assert got[1][1].startswith(filler) and got[1][1].endswith("tail") and "Fenlum" not in got[1][1] and got[1][3] > 100


def test_removal_of_every_copy(spark):
    filler = " ".join(f"filler{i}" for i in range(300))
    w = PASSAGE.split()
    reordered = " ".join([*w[14:], "plums", *w[:14]])
    docs = spark.createDataFrame([(1, f"{filler} {PASSAGE} {PASSAGE}", "a"), (2, f"{filler} {reordered} tail", "b"), (3, f"{filler} {PASSAGE} {PASSAGE.replace('spools', 'rolls')} {PASSAGE} tail", "c")], DOC)
    got = {r[0]: r[1] for r in rows(leaks.remove_leaks(docs, items(spark)))}
    assert {k: words(v)[300:] for k, v in got.items()} == {1: [], 2: ["plums", "tail"], 3: ["tail"]}


def test_many_copies():
    index = leaks.build_index([(1, f"{ASK}\n\n{PASSAGE}"), (2, f"{ASK}\n\n{OTHER}")], leaks.Rules())
    got = leaks.leaks_in(index, index.codes(words((PASSAGE + " ") * 200)), leaks.Rules())
    n = len(words(PASSAGE))
    assert sorted((x.first, x.last) for x in got) == [(k * n, k * n + n - 1) for k in range(200)]


def test_nothing_to_leak(spark):
    docs = spark.createDataFrame([(1, PASSAGE, "")], DOC)
    assert rows(leaks.leaked_pairs(docs, items(spark).where("false"))) == []
    assert rows(leaks.leaked_pairs(docs.where("false"), items(spark))) == []


# Mixing


def test_flow_is_exact():
    flow = mixing.min_cost_flow({1: 100, 2: 50, 3: 30}, [200, 60], [2, 3])
    given = [sum(n for (_, s), n in flow.items() if s == k) for k in range(2)]
    assert given == [200, 60]
    assert all(n <= {1: 100, 2: 50, 3: 30}[m] * [2, 3][s] and m >> s & 1 for (m, s), n in flow.items())
    assert mixing.min_cost_flow({1: 10}, [100], [3]) == {(1, 0): 30}  # short, at the cap
    many = mixing.min_cost_flow({1: 7, 3: 5}, [10**6, 10**5], [10**5, 10**5])  # no arc per repeat
    assert many[1, 0] + many[3, 0] == 10**6 and many[3, 1] == 10**5
    assert abs(many[1, 0] / 7 - (many[3, 0] + many[3, 1]) / 5) <= 1  # both are used equally often
    even = mixing.min_cost_flow({1: 100, 3: 100}, [150], [3])  # the second use of one is dearer than the first of the other
    assert max(even.values()) <= 100


def mixed(spark, documents, targets, **kw):
    docs = spark.createDataFrame([(i, s, t, 0) for i, (s, t) in enumerate(documents)], "doc_id long, source string, text string, tokens int")
    goal = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    return mixing.mix(docs, goal, **kw), goal


def test_mix_meets_targets(spark):
    rng = random.Random(2)
    docs = [(rng.choice(["Big ", "big", "BIG"]), f"big text number {i} " + "word " * rng.randint(1, 30)) for i in range(600)]
    docs += [("small-one", f"small {i} " + "word " * rng.randint(1, 30)) for i in range(60)]
    docs += [("small one", "big text number 5 word"), ("other", "no target"), ("big", None), ("big", ""), (None, "x")]
    docs += [("big", "copied " * 20)] * 300
    out, goal = mixed(spark, docs, [("big", 0.6, 1), ("small_one", 0.4, 4), ("small one", 0.4, 4), ("gone", 0.0, 2), (None, 0.5, 1)])
    held = out.collect()
    total = {s: sum(r.tokens * r.repeats for r in held if r.source == s) for s in ("big", "small_one")}
    assert abs(total["big"] / sum(total.values()) - 0.6) < 0.02
    assert max(r.repeats for r in held if r.source == "small_one") <= 4 and max(r.repeats for r in held if r.source == "big") == 1
    uses = Counter(docs[r.doc_id][1] for r in held for _ in range(1))
    assert uses["copied " * 20] <= 1  # one text, whatever its copies
    small = [r.repeats for r in held if r.source == "small_one"]
    assert max(small) - min(small) <= 1  # repetition is spread before it is deepened
    assert rows(out) == rows(mixed(spark, docs, [("big", 0.6, 1), ("small_one", 0.4, 4)])[0])
    for r in mixing.shares(out, goal).collect():
        assert abs(r.actual_share - total[r.source] / sum(total.values())) < 1e-9


def test_mix_short_and_empty(spark):
    out, goal = mixed(spark, [("a", "one two three"), ("b", "four five six")], [("a", 0.9, 2), ("b", 0.1, 1)], budget=1000)
    assert {(r.source, r.repeats) for r in out.collect()} == {("a", 2), ("b", 1)}
    assert rows(mixed(spark, [], [("a", 1.0, 1)])[0]) == [] and rows(mixed(spark, [("a", "x")], [])[0]) == []


# Reading level

SIMPLE = ["the cat sat", "a dog ran", "the sun is hot", "we eat and play", "mum has a red hat"]
HARD = ["ostensible epistemology corroborates heterogeneous calibration", "notwithstanding incontrovertible verisimilitude", "thermoregulation attenuates circumscribed scholarship", "meretricious assurances obfuscate residual credibility"]


def corpus(rng, n):
    out = []
    for i in range(n):
        level = rng.choice([1, 5])
        out.append((i, ". ".join(rng.choice(SIMPLE if level == 1 else HARD) for _ in range(rng.randint(2, 6))), level))
    return out


def test_levels_despite_noise(spark):
    rng = random.Random(3)
    held = corpus(rng, 400)
    labels = [(i, (6 - level if rng.random() < 0.1 else level), "r") for i, _, level in held[:200]]
    labels += [(0, None, "r"), (None, 3, "r"), (1, 9, "r"), (10**6, 2, "r")]
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in held] + [(1000, None, 0), (1001, " ... 12 ", 0), (1002, "THE CAT SAT " * 20_000, 0), (0, held[0][1], 7)], "doc_id long, text string, level int")
    got = {r[0]: r[1] for r in rows(reading.reading_levels(docs, spark.createDataFrame(labels, "doc_id long, level int, rater string")))}
    right = sum(got[i] == level for i, _, level in held[200:])
    assert right >= 198 and got[1000] is None and got[1001] is None and got[1002] == 1


def test_levels_without_labels(spark):
    docs = spark.createDataFrame([(1, "the cat sat. a dog ran."), (2, " ".join(HARD))], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, level int, rater string")
    got = dict(rows(reading.reading_levels(docs, labels)))
    assert got[1] < got[2]
    assert rows(reading.reading_levels(docs.where("false"), labels)) == []
