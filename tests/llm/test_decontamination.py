import random

import numpy as np

from keytempo.llm import decontamination


def plain_alignment(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (2 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        best, row = max(best, *new), new
    return best


def test_alignment_scores():
    rng = np.random.default_rng(1)
    a = [rng.integers(0, 4, rng.integers(3, 20)).astype(np.uint64) for _ in range(40)]
    b = [rng.integers(0, 4, rng.integers(1, 40)).astype(np.uint64) for _ in range(40)]
    score, _ = decontamination.align(a, b)
    assert score.tolist() == [plain_alignment(list(x), list(y)) for x, y in zip(a, b, strict=True)]


def cases():
    rnd = random.Random(2)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    vocabulary = [word() for _ in range(300)]
    text = lambda n: [rnd.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(rnd.randint(15, 60)))) for i in range(12)]
    items += [(90, None), (91, ""), (92, "two words"), (93, items[0][1]), (94, " ".join(text(400)))]
    docs, want = [], set()
    for d in range(60):
        body = text(rnd.randint(0, 300))
        if d % 3 == 0:
            i, t = items[rnd.randrange(12)]
            w = t.split()
            if d % 2:  # edited: every seventh word is replaced, one left out, one added
                w = [x if k % 7 else rnd.choice(vocabulary) for k, x in enumerate(w)]
                w = [*w[:5], *w[6:9], "extra", *w[9:]]
            at = rnd.randint(0, len(body))
            body = [*body[:at], *(x.upper() + "," for x in w), *body[at:]]
            want.add((d, i))
        docs.append((d, " ".join(body)))
    whole = items[-1][1].split()
    docs += [(200, None), (201, ""), (202, items[1][1]), (202, items[1][1]), (None, items[2][1]), (203, " ".join(whole[30:330]))]
    want |= {(202, 1), (None, 2), (203, 94)}
    return items, docs, {*want, *((d, 93) for d, i in want if i == 0)}


def test_leaks_are_found_and_clean_texts_left_alone(spark, frame):
    items, docs, want = cases()
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.leaks(frame(docs), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    assert len([r for r in got if r.doc_id == 202]) == 2  # a repeated row is reported again
    assert all(0.6 <= r.similarity <= 1 and r.start_word < r.end_word for r in got)
    odd = frame(docs).withColumnRenamed("source", "row").withColumnRenamed("lang", "lower")
    kept = decontamination.without_leaks(odd, benchmark)
    assert kept.columns == odd.columns
    bad = {d for d, _ in want}
    assert sorted(map(repr, (r.doc_id for r in kept.collect()))) == sorted(repr(d) for d, _ in docs if d not in bad)


def test_blocks_and_empty_tables(spark, frame, monkeypatch):
    items, docs, want = cases()
    monkeypatch.setattr(decontamination.blocks, "__defaults__", (5,))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(docs), benchmark).collect()} == want
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.leaks(frame(docs), none).count() == 0
    assert decontamination.leaks(frame([]), benchmark).count() == 0
    assert decontamination.without_leaks(frame(docs), none).count() == len(docs)


def test_copies_across_passage_borders_and_edited_short_items(spark, frame):
    rnd = random.Random(9)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(6))
    text = lambda n: [word() for _ in range(n)]
    long, middle, short = text(400), text(190), text(8)
    # Edits of words 1 and 5 leave one trigram in a row of three, which is also the item's most frequent.
    edited = [short[0], "zz", *short[2:5], "zz", *short[6:]]
    docs = [(k, " ".join([*text(40), *long[k:k + 77], *text(40)])) for k in range(0, 324, 19)]
    docs += [(1000, " ".join([*text(40), *long[180:330], *text(40)])), (1001, " ".join([*text(40), *middle[40:150], *text(40)])),
             (1002, " ".join([*text(40), *edited, *text(40)])), (1003, " ".join([*text(40), *long[100:160], *text(40)]))]
    docs += [(2000 + k, " ".join([*text(5), *short[2:5], *text(5)])) for k in range(9)]
    docs += [(3000 + k, " ".join([*text(5), *short[k:k + 3], *text(5)])) for k in range(6)]
    benchmark = spark.createDataFrame([(1, " ".join(long)), (2, " ".join(middle)), (3, " ".join(short))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(frame(docs), benchmark).collect()}
    assert got == {*((k, 1) for k in range(0, 324, 19)), (1000, 1), (1001, 2), (1002, 3)}


def test_whole_items_are_covered_end_to_end():
    for n in range(700):
        parts = decontamination.passages(n)
        assert all(0 <= a <= b <= n for a, b in parts)
        assert n > 192 or (0, n) in parts
        # Any run of 77 words of an item of more than 128 lies whole in a passage of 128.
        assert n <= 128 or all(any(a <= k and k + 77 <= b and b - a == 128 for a, b in parts) for k in range(n - 76))
