import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidegrid.llm import queries as Q
from tidegrid.llm.leakage import LETTERS, WORDS, functions_for, leaked, size_classes
from tidegrid.llm.packing import pack, token_count
from tidegrid.llm.repetition import _measure, repeated_units, repetition, suffix_array
from tidegrid.llm.text import is_cjk, letter_units, plain, repair, words

TOKENS = (f"{Q.TOKENIZERS}/byte_bpe_multi_50k.tiktoken", Q.PATTERN)


def test_plain_text():
    assert plain("  <b>Äpfel</b>&amp; ＣＡＦÉ​!") == "   apfel & cafe!"
    assert plain("gespÃ¼lt") == plain("gespült") == "gespult"
    assert repair("schön – déjà") == "schön – déjà"
    assert plain(None) == plain("") == ""
    assert words("Don't stop_me 12-3".casefold()) == ["don", "t", "stop", "me", "12", "3"]
    assert is_cjk("これはペンです pen") and not is_cjk("pen これ long words here") and not is_cjk("123")


# -- packing ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("rule", "most", "over"), [("norm", 128, 1.01), ("dot", 128, 1.01), ("norm", 30, 1.3)])
def test_pack(spark, rule, most, over):
    rng = random.Random(1)
    sizes = [int(rng.lognormvariate(4, 1)) for _ in range(3000)] + [0, None, -5, 100, 101, 2048, 2049, 5000, 9000]
    df = spark.createDataFrame([(i, n, "x", "y") for i, n in enumerate(sizes)], "id long, n long, container string, _n string")
    got = pack(df, "id", "n", 2048, max_items=most, rule=rule).collect()
    by, bins = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.id].append(r)
        bins[r.container].append(r)
    for i, n in enumerate(sizes):
        n = max(n or 0, 0)
        pieces = sorted(by[i], key=lambda r: r.piece)
        assert [p.first_token for p in pieces] == list(range(0, max(n, 1), 2048)) and sum(p.tokens for p in pieces) == n
    for rows in bins.values():
        assert sum(r.tokens for r in rows) <= 2048 and len(rows) <= most
        assert sum(r.tokens**2 for r in rows) <= 2048**2
    need = sum(max(n or 0, 0) for n in sizes) / 2048
    assert len(bins) <= over * need + 2
    again = pack(df, "id", "n", 2048, max_items=most, rule=rule).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert pack(df.limit(0), "id", "n").count() == 0


@pytest.mark.parametrize(("most", "attention"), [(256, None), (20, None), (256, 150_000), (24, 250_000)])
def test_every_limit_binds_and_partitions_do_not_matter(spark, most, attention):
    rng = random.Random(2)
    sizes = [int(rng.lognormvariate(4, 1)) + 1 for _ in range(2500)]
    sizes = [min(n, 350) for n in sizes]
    df = spark.createDataFrame(list(enumerate(sizes)), "id long, n long")
    results = []
    for partitions in ("4", "64"):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            results.append(sorted(map(tuple, pack(df.repartition(int(partitions)), "id", "n", 2048, most, attention, block=500).collect())))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert results[0] == results[1]
    bins = defaultdict(list)
    for _, _, _, tokens, container in results[0]:
        bins[container].append(tokens)
    limit = attention or 2048**2
    assert all(sum(b) <= 2048 and len(b) <= most and sum(t * t for t in b) <= limit for b in bins.values())
    # No packing can do with fewer containers than the scarcest of the three asks for.
    least = max(sum(sizes) / 2048, len(sizes) / most, sum(n * n for n in sizes) / limit)
    assert len(bins) <= 1.08 * least + 2, (len(bins), least)


def test_an_item_over_a_limit_stands_alone(spark):
    df = spark.createDataFrame([(1, 90), (2, 5), (3, 6)], "id string, n long")
    got = {r.id: r.container for r in pack(df, "id", "n", 100, max_attention=100).collect()}
    assert len({got["1"]} & {got["2"], got["3"]}) == 0 and got["2"] == got["3"]


def test_token_counts(spark):
    texts = ["Hello world", "", None, "<|endoftext|>", "日本語のテキスト", "x" * 30_000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count(F.col("t"), *TOKENS)).collect()]
    assert got[0] == 2 and got[1] == got[2] == 0 and got[3] > 1 and got[4] > 2 and got[5] > 100


# -- repetition -------------------------------------------------------------------------------------------


def brute(units, least):
    seen, hit = set(), [False] * len(units)
    for i in range(len(units) - least + 1):
        g = tuple(units[i : i + least])
        if g in seen:
            hit[i : i + least] = [True] * least
        seen.add(g)
    return hit


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=25), min_size=1, max_size=4), st.integers(1, 5))
def test_repeated_units(docs, least):
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    units = np.array([u for d in docs for u in d], np.int64)
    hit, longest = repeated_units(units, doc, np.full(len(units), least))
    assert hit.tolist() == [h for d in docs for h in brute(d, least)]
    at = 0
    for d in docs:
        top = max((n for i in range(len(d)) for j in range(i) for n in range(len(d) - i + 1) if d[i : i + n] == d[j : j + n]), default=0)
        assert max(longest[at : at + len(d)], default=0) == top
        at += len(d)


def test_suffix_array_sorts_suffixes():
    units = np.array([1, 0, 1, 0, 2], np.int64)
    order, lcp = suffix_array(units, np.zeros(5, np.int64))
    assert order.tolist() == sorted(range(5), key=lambda i: units[i:].tolist()) and lcp.tolist() == [0, 1, 0, 2, 0]


def test_repetition(spark):
    cases = {"": 0, "a b c d": 0, "One two three four. ONE, two; three 7 four!": 0.5, "neat " * 50: None, "<br>x y z w<br>x y z w": 0.5, "ありがとうございますね。ありがとうございますね！": 0.5}
    df = spark.createDataFrame([(t, 1) for t in [*cases, None]], "text string, share int")
    got = df.select("text", repetition(F.col("text")).alias("r")).collect()
    for r in got:
        want = cases.get(r.text, 0) if r.text else 0
        if want is not None:
            assert r.r.share == want, r
        else:
            assert r.r.units == 50 and r.r.repeated == 49 and r.r.longest == 49
    long = _measure(["lorem ipsum dolor sit amet " * 20_000], 4, 10)
    assert long.share[0] > 0.999
    assert letter_units("これは12ペンです")[1]


# -- leakage ----------------------------------------------------------------------------------------------

RNG = random.Random(3)
NAMES = ["".join(RNG.choice("bdfgklmnprstvz") + RNG.choice("aeiou") for _ in range(3)) for _ in range(900)]
KANA = [chr(c) for c in range(0x30A2, 0x30F3)]


def passage(k, rng):
    if k % 5 == 4:
        return "".join("".join(rng.sample(KANA, 40)) + "。" for _ in range(3))
    return " ".join(f"The {rng.choice(NAMES)} from {rng.choice(NAMES)} left the {rng.choice(NAMES)} beside a {rng.choice(NAMES)} shed, so the {rng.choice(NAMES)} froze while {rng.choice(NAMES)} was still searching {rng.randint(2, 90)} streets away." for _ in range(3))


def corpus():
    rng = random.Random(4)
    items = [(k, passage(k, rng)) for k in range(40)]
    filler = lambda n: " ".join(rng.choice(NAMES) for _ in range(n))
    docs, want = [], set()
    for k, p in items:
        cjk = k % 5 == 4
        for way in range(6):
            d = len(docs)
            if cjk:
                cut = rng.randint(0, 60)
                part = p[cut : cut + 30].replace("。", "、") if way else p
                part = part[:13] + "ン" + part[14:] if way == 2 and len(part) > 28 else part
                docs.append((d, "商品はとても" + part + "よかったです" * (way == 3)))
            else:
                w = p.split()
                cut = rng.randint(0, len(w) - 15)
                part = {0: p, 1: " ".join(w[cut : cut + 12]), 2: " ".join([*w[cut : cut + 7], "oops", *w[cut + 8 : cut + 15]]), 3: p.upper().replace(" ", "  "), 4: "<p>" + "<br>".join(w[cut : cut + 14]) + "</p>", 5: p.split(". ")[0]}[way]
                docs.append((d, filler(rng.choice([0, 30, 2000])) + " " + part + " " + filler(rng.choice([0, 25]))))
            want.add((k, d))
    for k, p in items:
        if k % 5 != 4:
            w = p.split()
            docs.append((len(docs), filler(20) + " " + " ".join(w[:6]) + " " + filler(5)))
            docs.append((len(docs), passage(0, rng)))
    docs += [(len(docs), None), (len(docs) + 1, ""), (len(docs) + 2, "short")]
    return items, docs, want


@pytest.mark.parametrize("block", [7, 2000])
def test_leaks(spark, block):
    items, docs, want = corpus()
    d = spark.createDataFrame([(*x, 0) for x in docs + docs[:2]], "id long, body string, eval_id int").repartition(3)
    e = spark.createDataFrame([(*x, "q") for x in [*items, (99, None), (98, ""), (97, "too short")]], "eval_id long, passage string, question string")
    got = {(r.eval_id, r.id) for r in leaked(d, "id", "body", e, "eval_id", "passage", block).collect()}
    assert len(want - got) <= 0.01 * len(want), sorted(want - got)[:5]
    assert not got - want
    assert leaked(d.limit(0), "id", "body", e, "eval_id", "passage").count() == 0
    assert leaked(d, "id", "body", e.limit(0), "eval_id", "passage").count() == 0


def test_sentence_of_several_items_counts_for_each(spark):
    s = passage(0, random.Random(9)).split(". ")[0] + "."
    e = spark.createDataFrame([(1, s + " Else one."), (2, s)], "eval_id long, p string")
    d = spark.createDataFrame([(7, "well. " + s)], "id long, t string")
    assert Counter(r.eval_id for r in leaked(d, "id", "t", e, "eval_id", "p").collect()) == {1: 1, 2: 1}


def shared_vocabulary(rng):
    """Test items of which many share their words, and documents with runs of them, whole and altered."""
    few = NAMES[:60]
    items = [(k, " ".join(rng.choice(few if k % 2 else NAMES) for _ in range(40)) + ".") for k in range(60)]
    docs = []
    for k, p in items:
        w = p.rstrip(".").split()
        for alter in (False, True):
            cut = rng.randint(0, 24)
            run = w[cut : cut + 15]
            docs.append((len(docs), " ".join([*rng.choices(NAMES, k=30), *(run[:7] + ["zzz"] + run[8:] if alter else run), *rng.choices(NAMES, k=9)])))
    return items, docs


def test_leaks_do_not_depend_on_blocks_and_loads(spark):
    items, docs = shared_vocabulary(random.Random(11))
    d, e = spark.createDataFrame(docs, "id long, t string").repartition(3), spark.createDataFrame(items, "item long, p string")
    found = lambda e, **k: {(r.item, r.id) for r in leaked(d, "id", "t", e, "item", "p", **k).collect()}
    whole = found(e)
    assert whole == found(e.repartition(5), block=7) == found(e.orderBy(F.desc("item")), block=20, index_bytes=1)
    # Held against a search of all pairs that knows nothing of shingles: 12 words of the passage in a row.
    runs = lambda w: {tuple(w[i : i + 12]) for i in range(len(w) - 11)}
    want = {(k, i) for k, p in items for i, t in docs if runs(words(p)) & runs(words(t))}
    assert len(want) >= 60 and len(want - whole) <= 0.01 * len(want)
    exact = found(e, exact=True)
    assert want <= exact and whole <= exact and len(exact - whole) <= 0.01 * len(exact)


def test_a_sentence_inside_a_longer_run_counts(spark):
    e = spark.createDataFrame([(1, "Bagu left the old mill early. Nobody saw him go.")], "item long, p string")
    d = spark.createDataFrame([(1, "x Bagu left the old mill early nobody y"), (2, "the old mill early"), (3, "a <b and Bagu left the old mill > early")], "id long, t string")
    assert [r.id for r in leaked(d, "id", "t", e, "item", "p").collect()] == [1]
    assert plain("<a href='" + "x" * 500 + "'>b</a> 1 < 2 > 0") == " b  1 < 2 > 0"


def test_more_functions_for_larger_segments():
    for mode in (WORDS, LETTERS):
        sizes = size_classes(mode)
        assert [n for _, n in sizes] == sorted(n for _, n in sizes)
        assert sizes[-1] == (2 * mode.half, functions_for(mode, 2 * mode.half))
