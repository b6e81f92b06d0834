"""Operator 10 against a plain search."""

import random
import time

from elotrail.llm.decontaminate import Automaton, find_benchmark, spans, words_of


def plain(items, text):
    ws, hit, found = words_of(text or ""), set(), set()
    for i, t in items:
        iw = words_of(t or "")
        size = min(10, len(iw))
        wins = {tuple(iw[k:k + size]) for k in range(len(iw) - size + 1)} if iw else set()
        for k in range(len(ws) - size + 1):
            if tuple(ws[k:k + size]) in wins:
                hit.update(range(k, k + size))
                found.add(str(i))
    return len(ws), len(hit), sorted(found)


def make(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "B", "ä", "x1", "c-d", "É!", "the"])
    items = [(k, " ".join(word() for _ in range(rng.choice([3, 9, 10, 11, 30])))) for k in range(12)]
    items += [(50, None), (51, "  ..."), (3, "second text of item three and some more words to fill it up")]
    texts = [" ".join(word() for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [f"new words {items[0][1]} more", items[4][1].upper(), "", "...", None, items[-1][1]]
    return items, texts


def test_equals_a_plain_search(spark):
    for seed, block in ((1, 1 << 20), (2, 60)):  # one automaton, and several
        items, texts = make(seed)
        docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(0, texts[0], 1)],
                                     "doc_id long, text string, items int")
        bench = spark.createDataFrame(items, "item_id long, text string")
        out = find_benchmark(docs, bench, block_bytes=block).collect()
        assert len(out) == len(texts) + 1
        for r in out:
            assert (r["n_words"], r["n_hit"], r["items"]) == plain(items, texts[r["doc_id"]])
        assert find_benchmark(docs.limit(0), bench).count() == 0
        assert {r["n_hit"] for r in find_benchmark(docs, bench.limit(0)).collect()} == {0}


def test_spans_do_not_depend_on_blocks(spark):
    items, texts = make(3)
    long_ = " ".join(f"w{k}" for k in range(60))
    items += [(100 + k, " ".join(f"w{j}" for j in range(5 * k, 5 * k + 15))) for k in range(9)]
    items += [(200, "w50 w51 w52"), (201, "w58 w59")]
    texts += [f"Ä {long_} end", f"{long_}. {long_}", "w50 W51, w52 - w58 w59"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one, many = ({r["doc_id"]: r for r in find_benchmark(docs, bench, block_bytes=b).collect()}
                 for b in (1 << 20, 250))
    assert one == many and any(len(r["spans"]) > 1 for r in one.values())


def test_spans_lie_in_the_original():
    item = "One two, three four FIVE six sevän eight nine ten"
    auto = Automaton([("q", item)])
    text = f"Ünrelated — start: {item.upper().replace('Ä', 'ä')}! and more"
    h = auto.scan(text)
    (a, b), = spans(text, h.runs)
    assert words_of(text[a:b]) == words_of(item) and h.n_words == 15 and h.items == ["q"]


def test_spans_of_very_many_runs():
    text = "é hit, x ÿ HIT\ud800 y " * 400_000  # 10 MB
    n = len(words_of(text[:len(text) // 400_000]))
    runs = [(k * n + 1, k * n + 1) for k in range(400_000)]
    start = time.monotonic()
    found = spans(text, runs)
    assert time.monotonic() - start < 20 and len(found) == len(runs)
    assert all(text[a:b] == "hit" for a, b in found)


def test_many_words_need_more_digits():
    item = " ".join(f"w{k}" for k in range(5000))
    auto = Automaton([("q", item)])
    assert auto.digits == 3
    assert auto.scan("x " + " ".join(f"w{k}" for k in range(100, 115)) + " y").runs == [(1, 15)]
    assert not auto.scan(" ".join(f"w{2 * k}" for k in range(100))).runs
