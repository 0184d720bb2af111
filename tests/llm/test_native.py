import collections
import random
import zlib

import pytest

from keytempo.llm import chat, packing, sharding
from keytempo.llm.common import numbered


def test_numbers_have_no_gaps(spark):
    rows = [(random.Random(i).randint(0, 3), i % 50) for i in range(400)] + [(None, None)] * 5
    got = numbered(spark.createDataFrame(rows, "g int, v int").repartition(4), ["g"], ["v"], "k").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.g].append(r.k)
    assert sum(map(len, by.values())) == 400  # rows without a group are asked for by nobody
    assert all(sorted(v) == list(range(len(v))) for g, v in by.items() if g is not None)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 39, 40, 41, 1000])
def test_shards(frame, n):
    docs = [(i, f"text {i}") for i in range(n)]
    got = sharding.shard_documents(frame(docs).withColumnRenamed("source", "place"), 40).collect()
    assert sorted(r.place for r in got) == list(range(n))
    by = collections.defaultdict(list)
    for r in got:
        by[r.shard].append(r.slot)
        assert r.size == len(f"text {r.doc_id}") + 16 and r.text_crc32 == zlib.crc32(f"text {r.doc_id}".encode())
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    sizes = [len(by[s]) for s in range(40)]
    assert max(sizes) - min(sizes) <= 1
    again = sharding.shard_documents(frame(docs[::-1]).repartition(5), 40).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == {(r.doc_id, r.shard, r.slot) for r in again}


def test_shards_of_odd_rows(frame):
    docs = [(1, None), (1, None), (None, "é"), (2, ""), (2, "")]
    got = sharding.shard_documents(frame(docs), 2).collect()
    assert sorted((r.size, r.text_crc32) for r in got if r.text_crc32 is not None) == [(16, 0), (16, 0), (18, zlib.crc32("é".encode()))]
    assert sorted((r.shard, r.slot) for r in got) == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1)]


def check_packing(rows, sizes):
    bins = collections.defaultdict(list)
    for r in rows:
        if r["length"]:
            bins[r["bin_id"]].append(r)
    for inside in bins.values():
        at = 0
        for r in sorted(inside, key=lambda r: r["bin_offset"]):
            assert r["bin_offset"] == at
            at += r["length"]
        assert {r["bin_content"] for r in inside} == {at}
        assert {r["bin_capacity"] for r in inside} == {min(s for s in sizes if s >= at)}
    assert sorted(bins) == list(range(len(bins)))
    return len(bins)


def test_packing_is_valid_and_tight(frame):
    rnd = random.Random(3)
    docs = [(i, " ".join(["w"] * rnd.choice([0, 1, 3, 7, 12, 20, 40, 75]))) for i in range(300)]
    docs += [(900, None), (901, " \n"), (None, "a b c"), (902, docs[7][1]), (7, docs[7][1]), (7, docs[7][1])]
    got = [r.asDict() for r in packing.pack(frame(docs).withColumnRenamed("source", "piece"), (8, 16, 32)).collect()]
    bins = check_packing(got, (8, 16, 32))
    total = sum(r["length"] for r in got)
    assert total == sum(len(t.split()) + 1 for _, t in docs if t is not None) and bins <= total / 32 * 1.1 + 1
    by = collections.defaultdict(list)
    for r in got:
        by[r["doc_id"]].append((r["piece"], r["first_word"], r["length"], r["bin_id"]))
    assert by[900] == [(0, 0, 0, None)] and by[901][0][2] == 1
    long = next(d for d, t in docs if t and len(t.split()) == 75)
    assert [(p, f, n) for p, f, n, _ in sorted(by[long])][:3] == [(0, 0, 32), (1, 32, 32), (2, 64, 12)]
    assert packing.pack(frame([])).count() == 0


def naive_best_fit(lengths, size):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fit = [i for i, r in enumerate(rooms) if r >= n]
        if fit:
            rooms[min(fit, key=lambda i: rooms[i])] -= n
        else:
            rooms.append(size - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(6))
def test_plan_equals_best_fit_decreasing_for_one_size(seed):
    rnd = random.Random(seed)
    lengths = [rnd.randint(1, 50) for _ in range(rnd.randint(1, 300))]
    _, bins = packing.fill(collections.Counter(lengths), (50,))
    assert sum(b[1] for b in bins) == naive_best_fit(lengths, 50)


def test_sizes_are_chosen_jointly():
    plan = packing.plan({300: 10, 900: 4}, (512, 1024, 2048))
    total = sum({(p[3] + k, p[5]): packing.cost(p[5]) for p in plan for k in range(p[2])}.values())
    alone = []
    for sizes in ((512, 1024, 2048), (1024,), (2048,), (1024, 2048), (512, 2048)):
        _, bins = packing.fill({300: 10, 900: 4}, sizes)
        alone.append(sum(b[1] * packing.cost(packing.downsized(b[2], (512, 1024, 2048))) for b in bins))
    assert total <= min(alone)


def render(rows, me):
    text, spans = "", []
    for _, who, said in rows:
        head = "assistant" if who == me else "system" if who == "system" else f"user name={who}"
        text += f"<|start|>{head}\n"
        if who == me:
            spans.append((len(text), len(text) + len(said) + len("<|end|>\n")))
        text += f"{said}<|end|>\n"
    return text, spans


def test_every_participants_view(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|end|>"), (1, 2, "bob", "é"), (1, 3, "ann", None), (1, 2, "bob", "é"),
            (2, 0, None, "alone"), (2, None, "  ", "before"), (3, 0, "system", "nobody"), (None, 0, "x", "y"),
            *[(4, k, f"p{k % 3}", f"m{k}") for k in range(130)], *[(5, 7, "a", f"t{k:03}") for k in range(50)], (5, 8, "b", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", *[chat.F.lit(1)])
    got = {(r.conv_id, r.perspective, r.segment, r.part): r for r in chat.rotate(df.repartition(3), 64, 20).collect()}
    one = render([(0, "system", "be kind"), (1, "ann", "hi < |end|>"), (2, "bob", "é"), (3, "ann", "")], "ann")
    r = got[1, "ann", 0, 0]
    assert (r.rendered, [tuple(s) for s in r.mask], r.n_messages, r.n_trained) == (*one, 4, 2)
    assert got[1, "bob", 0, 0].n_trained == 1 and (3, "system", 0, 0) not in got
    assert got[2, "unknown", None, 0].rendered.count("before") == 1 and got[None, "x", 0, 0].n_messages == 1
    # Two blocks of conversation 4 have 64 messages, more than 20: a segment for each turn; the last has two and is one.
    assert sum(k[0] == 4 for k in got) == 129 * 3
    # Turn 7 of conversation 5 is dealt to parts by hash, none is lost.
    assert sum(r.n_messages for k, r in got.items() if k[0] == 5 and k[1] == "b") == 51
    whole = {k: r for k, r in ((( r.conv_id, r.perspective, r.segment), r) for r in chat.rotate(df, 64, 1000).collect())}
    assert whole[4, "p1", 64].n_messages == 64 and whole[4, "p1", 128].rendered == render([(128, "p2", "m128"), (129, "p0", "m129")], "p1")[0]
    assert chat.rotate(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_crowded_turns_are_cut_in_order(spark):
    """Messages of a turn stay in order across its parts, and every part but the last is full."""
    rows = [(c, 7, f"p{k % 3}", f"t{k:04}") for c in (5, None) for k in range(130)] + [(5, 8, "b", "z"), (6, 0, "a", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = chat.rotate(df, 64, 20).where("perspective = 'p1' and segment = 7").collect()
    for c in (5, None):
        parts = sorted((r.part, r) for r in got if r.conv_id == c)
        assert [p for p, _ in parts] == list(range(7)) and [r.n_messages for _, r in parts] == [20] * 6 + [10]
        want = sorted((7, who, said) for i, _, who, said in rows if i == c and said[0] == "t")
        for p, r in parts:
            text, spans = render(want[p * 20:(p + 1) * 20], "p1")
            assert r.rendered == text and [tuple(s) for s in r.mask] == spans


def test_packed_texts_make_up_the_documents(frame):
    texts = [None, "", "  ", "a", " ".join("abcdefgh"), "x" + " y" * 7 + "  ", "\n" + "wörd \t" * 100, "q " * 24]
    docs = frame(list(enumerate(texts)))
    got = packing.pack(docs, (4, 8), with_text=True).orderBy("doc_id", "piece").collect()
    for i, t in enumerate(texts):
        pieces = [r for r in got if r.doc_id == i]
        assert [r.text for r in pieces] == [None] if t is None else "".join(r.text for r in pieces) == t
        if t is not None:
            assert [r.length for r in pieces] == [len(r.text.split()) for r in pieces[:-1]] + [len(pieces[-1].text.split()) + 1]
    plain = packing.pack(docs, (4, 8)).orderBy("doc_id", "piece").collect()
    assert [(r.doc_id, r.piece, r.length) for r in plain] == [(r.doc_id, r.piece, r.length) for r in got]
