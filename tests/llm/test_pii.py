import re
import time

from keytempo.llm import common, pii

TEXTS = [
    (1, "Write to anna.weber@mail.example.com or call +1 (974) 555-3436."),
    (2, "ANNA.WEBER@MAIL.EXAMPLE.COM again, card 4952935900253052, ip 169.122.221.182!!"),
    (3, "card 4952-9359-0025-3052 and token = \"abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71\""),
    (4, "Mrs. Anna Weber met Mr Karl Weber; HERR stays. Mr Weber left. Господин Антон Петров"),
    (5, "IBAN DE89 3704 0044 0532 0130 00, ssn 078-05-1120, 19745553436 alone"),
    (6, "No data: 9807915762804490, version 1.2.3.4.5, 2004-01-01, 300.1.1.1, a@b, 12345"),
    (7, None), (8, ""), (1, "Write to anna.weber@mail.example.com or call +1 (974) 555-3436."), (None, "ip 169.122.221.182"),
    (1, "other text, same id: ip 169.122.221.182"),
]


def entities(text):
    return {(k, e) for _, _, k, e in pii.find(text or "")}


def test_found_entities():
    assert entities(TEXTS[0][1]) == {("email", "anna.weber@mail.example.com"), ("phone", "19745553436")}
    assert entities(TEXTS[2][1]) == {("card", "4952935900253052"), ("secret", "abe29cfcdae4f03e1e339fcaa4c5bb6c83baff71")}
    assert entities(TEXTS[3][1]) == {("given-f", "anna"), ("given-m", "karl"), ("given-m", "антон"), ("family", "weber"),
                                     ("family", "петров")}
    assert entities(TEXTS[4][1]) == {("iban", "DE89370400440532013000"), ("ssn", "078051120")}
    assert entities(TEXTS[5][1]) == set()


def test_surrogates_keep_kind_format_and_coreference(frame):
    docs = frame(TEXTS).withColumnRenamed("source", "names").withColumnRenamed("lang", "maybe")
    got = pii.with_surrogates(docs, count="n")
    assert got.columns == [*docs.columns, "n"]
    rows = sorted(((r.doc_id, r.text, r.n) for r in got.collect()), key=repr)
    assert len(rows) == len(TEXTS)
    by = {}
    for d, t, n in rows:
        by.setdefault(d, []).append((t, n))
    assert by[6] == [(TEXTS[5][1], 0)] and by[7] == [(None, 0)] and by[8] == [("", 0)]
    assert by[1][0] == by[1][1] or by[1][1] == by[1][2]  # the repeated row
    one = next(t for t, _ in by[1] if "Write" in t)
    mail = re.search(r"\S+@\S+\.example", one)[0]
    assert mail.upper() in by[2][0][0] and "weber" not in (one + by[2][0][0]).lower()
    assert re.search(r"call \+1 \(\d{3}\) \d{3}-\d{4}\.", one) and "974" not in one
    card = re.search(r"card (\d{16})", by[2][0][0])[1]
    assert pii.luhn(card) and card[0] == "4" and card == re.search(r"card ([\d-]{19})", by[3][0][0])[1].replace("-", "")
    ips = {re.search(r"ip (\S+?)(!!)?$", t)[1] for t in (by[2][0][0], by[None][0][0], next(t for t, _ in by[1] if "other" in t))}
    assert len(ips) == 1 and "169.122.221.182" not in ips
    assert re.search(r'token = "[0-9a-f]{40}"', by[3][0][0])
    m = re.match(r"Mrs\. (\S+) (\S+) met Mr (\S+) (\S+); HERR stays\. Mr (\S+) left\. Господин (\S+) (\S+)$", by[4][0][0])
    assert m[2] == m[4] == m[5] != "Weber" and m[1].lower().split("-")[0] in [x.lower() for x in pii.GIVEN["latin", "f"]]
    assert re.fullmatch("[А-Яа-яё-]+", m[6]) and re.fullmatch("[А-Яа-яё]+", m[7])
    iban = re.search(r"IBAN (.{27})", by[5][0][0])[1]
    assert pii.iban_remainder(iban.replace(" ", "")) == 1 and iban[:2] == "DE" and iban != "DE89 3704 0044 0532 0130 00"


def test_no_collisions_in_small_spaces(spark):
    """200 IPv4 addresses of the form d.d.d.d have 6,561 surrogates of that form: draws collide and are repeated."""
    known = [("ip", f"{a}.{b}.{c}.1") for a in range(1, 10) for b in range(1, 6) for c in range(1, 6)]
    known += [("given-f", f"name{i}") for i in range(60)]
    got = pii.surrogates(spark.createDataFrame(known, "kind string, entity string")).collect()
    assert len(got) == len(known) == len({(r.kind, r.surrogate) for r in got})
    assert not {(r.kind, r.surrogate) for r in got} & set(known)


def test_key_and_empty_table(frame):
    assert pii.with_surrogates(frame([])).count() == 0
    a = pii.surrogate(b"one", "card", "4952935900253052", 0)
    assert a != pii.surrogate(b"two", "card", "4952935900253052", 0) and a == pii.surrogate(b"one", "card", "4952935900253052", 0)


def test_whole_names_and_their_further_mentions():
    text = "Mr O'Brien met Frau Müller-Lüdenscheidt and Dr. McDonald's son. O'Brien left; MCDONALD too. MR JOHN SMITH. Later Smith, John."
    words = [(text[s:e], k) for s, e, k, _ in pii.find(text)]
    assert words == [("O'Brien", "family"), ("Müller-Lüdenscheidt", "family"), ("McDonald", "family"), ("O'Brien", "family"),
                     ("MCDONALD", "family"), ("JOHN", "given-m"), ("SMITH", "family"), ("Smith", "family"), ("John", "given-n")]
    assert pii.find("Smith and John without a title") == []


def test_one_person_under_several_titles(frame):
    docs = frame([(1, "Mr John Smith"), (2, "Dr John Smith"), (3, "Dr Kim Lee. Later Kim came."), (4, "Mrs Kim Lee"), (5, "MR JOHN SMITH")])
    got = {r.doc_id: r.text for r in pii.with_surrogates(docs).collect()}
    one, two = got[1].split(" ", 1)[1], got[2].split(" ", 1)[1]
    assert one == two and one.upper() == got[5].split(" ", 1)[1]
    assert one.split(" ")[0].split("-")[0] in pii.GIVEN["latin", "m"]
    kim = got[4].split(" ")[1]
    assert kim.split("-")[0] in pii.GIVEN["latin", "f"] and got[3].split(" ")[1] == kim and f"Later {kim} came" in got[3]


def test_rounds_end_where_forms_are_used_up(spark):
    """Five one-letter domains with all their one-letter mailboxes; every address of one form is a known entity."""
    known = [("email", f"{chr(97 + i)}@{d}.com") for d in "epqtw" for i in range(26)]
    known += [("ip", f"{a}.{b}.{c}.{d}") for a in range(1, 10) for b in range(1, 10) for c in range(1, 10) for d in range(1, 10)]
    got = pii.surrogates(spark.createDataFrame(known, "kind string, entity string")).collect()
    new = {(r.kind, r.surrogate) for r in got}
    assert len(got) == len(known) == len(new) and not new & set(known)
    hosts = {(r.entity.split("@")[1], r.surrogate.split("@")[1]) for r in got if r.kind == "email"}
    assert len(hosts) == 5 == len({h for _, h in hosts})


def test_a_text_of_very_many_entities():
    text = " ".join(f"user{i}@host{i % 97}.com from 10.{i % 200}.{i // 200 % 250}.7" for i in range(50_000))
    begin = time.monotonic()
    assert len(pii.find(text)) == 100_000 and time.monotonic() - begin < 20


def test_stored_steps_hold_no_clear_text(spark, frame, tmp_path, monkeypatch):
    """What the stage leaves in the shared folder names no entity."""
    monkeypatch.setattr(common, "shared_folder", lambda _: str(tmp_path))
    pii.with_surrogates(frame([(1, "Write to anna.weber@mail.example.com. Mr Lindqvist")])).collect()
    folders = list(tmp_path.iterdir())
    assert folders
    for folder in folders:
        values = {bytes(v) if isinstance(v, bytearray) else v for r in spark.read.parquet(str(folder)).collect() for v in r}
        assert values and not values & {"anna.weber@mail.example.com", "lindqvist", b"lindqvist", "mail.example.com"}
