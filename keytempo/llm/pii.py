"""Personal data replaced by keyed, type-consistent surrogates.

1. ``find`` locates entities in a text: e-mail addresses, phone numbers, IPv4 addresses, payment cards (valid check digit
   only), IBANs (valid check digits only), US social security numbers, secrets assigned to a token-like name, and personal
   names after a title, with their further mentions in the same text.  Each has a normal form, so that spellings of one entity
   share one surrogate.
2. The distinct entities form a table.  A surrogate is drawn from HMAC(key, kind, entity, attempt); it keeps the kind's
   format and check digits, and for names gender (from the titles of all mentions), script and letter case.
3. Collision checks on that table: an entity whose surrogate is also another's, or is itself an entity of the corpus, draws
   again, until no collision is left; later draws are from wider forms, so rounds end.  The domains of e-mail addresses are
   entities of their own.  So distinct entities stay distinct and every mention of one is replaced alike.
4. Documents with entities fetch their own surrogates by a join; texts without a digit, an @ or a title pass in place.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
from bisect import bisect_right
from functools import reduce
from operator import or_

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keytempo.llm.common import columns_of, stored, table

KEY = b"keytempo-demo-key"  # callers give their own secret
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Don", "Mister", "Господин")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Doña", "Госпожа")
OPEN_TITLES = ("Dr", "Prof")
#: Given names per script and gender; family names are built from syllables.
GIVEN = {
    ("latin", "m"): "Adrian Bruno Carl David Emil Felix Hugo Ivan Jonas Leon Martin Oscar Paul Robert Simon Victor".split(),
    ("latin", "f"): "Alma Bianca Clara Diana Elena Flora Greta Helena Irene Julia Laura Maria Nora Olivia Paula Rosa".split(),
    ("latin", "n"): "Alex Andrea Chris Dana Kim Robin Sam Sascha".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Игорь Лев Олег Павел Роман".split(),
    ("cyrillic", "f"): "Анна Вера Дарья Елена Ирина Мария Нина Ольга".split(),
    ("cyrillic", "n"): "Саша Женя Валя Слава".split(),
}
SYLLABLES = {"latin": "bar bel cor dan del fen gar hol kar lan mar nor pel ran sol tar ver wen".split(),
             "cyrillic": "бар вел гор дан кал лен мар нор пол рад сол тан".split()}

#: Gender of every title, also in capitals.
TITLES = {form: g for g, titles in (("m", MALE), ("f", FEMALE), ("n", OPEN_TITLES)) for t in titles for form in (t, t.upper())}
_TITLE = "|".join(sorted(TITLES, key=len, reverse=True))
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿА-Яа-яЁё"
_WORD = rf"[A-ZÀ-ÖØ-ÞА-ЯЁ](?:[{_LETTER}]|-(?=[{_LETTER}])|['’](?!s(?![{_LETTER}]))(?=[{_LETTER}]))+"
PATTERNS = (
    ("email", re.compile(r"(?<![\w.%+-])[\w.%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w@])")),
    ("secret", re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|auth|token|secret|password|passwd)\b[\"']?\s*[=:]\s*"
                          r"[\"']?(?P<x>[A-Za-z0-9_\-./+]{12,})")),
    ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")),
    ("card", re.compile(r"(?<![0-9.-])[0-9](?:[ -]?[0-9]){12,18}(?![0-9-])")),
    ("ip", re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])")),
    ("ssn", re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9][0-9]-(?!0000)[0-9]{4}(?![0-9-])")),
    ("phone", re.compile(r"(?<![\w+.])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"
                         r"|(?:\([0-9]{3}\) ?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4})(?![0-9-]|\.[0-9])")),
    ("name", re.compile(rf"(?<!\w)(?P<t>{_TITLE})\.? (?P<x>{_WORD}(?: {_WORD})?)")),
)
_DIGITS = re.compile(r"[^0-9]")
_NAME = re.compile(rf"(?<!\w){_WORD}")


def may_hold(text):
    """A column that is false only for texts without entities: all kinds but names need a digit or an @."""
    titled = [F.contains(text, F.lit(t + mark)) for t in TITLES for mark in (" ", ". ")]
    return F.coalesce(reduce(or_, titled, text.rlike("[0-9@]")), F.lit(False))


def luhn(digits: str) -> bool:
    d = [int(x) for x in reversed(digits)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def iban_remainder(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def script_of(name: str) -> str:
    return "cyrillic" if "Ѐ" <= name[0] <= "ӿ" else "latin"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, normal form) of the entities of a text, in order and without overlaps.

    Kinds of names are given-m, given-f, given-n and family; a full name gives two entries, so "Mr A B" and "Mr B" agree.
    A word that is such a name elsewhere in the text is one without a title, too (family before given).  The work grows with
    the text and its number of entities, not with their square.
    """
    out: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # of earlier kinds, in order; hits of one kind never overlap

    def free(start: int, end: int) -> bool:
        k = bisect_right(taken, (start, end))
        return not (k < len(taken) and taken[k][0] < end or k and taken[k - 1][1] > start)

    for kind, pattern in PATTERNS:
        if kind == "email" and "@" not in text:
            continue
        new: list[tuple[int, int]] = []
        for m in pattern.finditer(text):
            start, end = m.span("x") if "x" in pattern.groupindex else m.span()
            if not free(start, end):
                continue
            value = text[start:end]
            digits = _DIGITS.sub("", value)
            if kind == "email":
                normal = value.lower()
            elif kind == "card":
                if not luhn(digits) or len(set(digits)) == 1:
                    continue
                normal = digits
            elif kind == "iban":
                normal = value.replace(" ", "")
                if not 15 <= len(normal) <= 34 or iban_remainder(normal) != 1:
                    continue
            elif kind == "ip":
                if any(int(x) > 255 for x in value.split(".")):
                    continue
                normal = value
            elif kind == "phone":
                if not 7 <= len(digits) <= 15:
                    continue
                normal = digits
            elif kind == "secret":
                if not re.search("[0-9]", value):
                    continue
                normal = value
            elif kind == "name":
                gender = TITLES[m["t"]]
                parts = value.split(" ")
                if len(parts) == 2:
                    out.append((start, start + len(parts[0]), f"given-{gender}", parts[0].lower()))
                out.append((end - len(parts[-1]), end, "family", parts[-1].lower()))
                new.append((start, end))
                continue
            else:
                normal = digits
            new.append((start, end))
            out.append((start, end, kind, normal))
        taken = sorted(taken + new)
    known = {e: "given-n" for _, _, k, e in out if k.startswith("given")} | {e: k for _, _, k, e in out if k == "family"}
    if known:
        out += [(*m.span(), known[m[0].lower()], m[0].lower()) for m in _NAME.finditer(text)
                if m[0].lower() in known and free(*m.span())]
    return sorted(out)


class Draw:
    """Numbers from HMAC-SHA256 of a message, as many as wanted."""

    def __init__(self, key: bytes, *parts):
        self.key, self.message, self.k, self.pool = key, "\x1f".join(map(str, parts)).encode(), 0, 0
        self.left = 0

    def below(self, n: int) -> int:
        if self.left < 32:
            block = hmac.new(self.key, self.message + b"\x1f%d" % self.k, hashlib.sha256).digest()
            self.k, self.pool, self.left = self.k + 1, int.from_bytes(block, "big"), 256
        self.left -= 32
        self.pool, value = self.pool >> 32, self.pool & 0xFFFFFFFF
        return value * n >> 32

    def like(self, text: str) -> str:
        """Letters for letters of the same case, digits for digits; hexadecimal texts stay so."""
        hexa = len(text) >= 12 and not re.search(r"[^0-9a-fA-F]", text)
        low, up = ("abcdef", "ABCDEF") if hexa else ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        return "".join("0123456789"[self.below(10)] if c.isdigit() else up[self.below(len(up))] if c.isupper()
                       else low[self.below(len(low))] if c.isalpha() else c for c in text)


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The normal form of the replacement of an entity."""
    draw = Draw(key, kind, normal, attempt)
    wider = attempt // 4  # forms with few members grow
    if kind == "email":  # the domain is replaced for itself
        local, _, domain = normal.rpartition("@")
        return f"{draw.like(local + 'x' * wider)}@{domain}"
    if kind == "domain":
        labels, _, _ = normal.rpartition(".")
        return f"{draw.like(labels + 'x' * wider)}.example"
    if kind == "card":
        body = normal[0] + draw.like(normal[1:-1])
        return next(body + c for c in "0123456789" if luhn(body + c))
    if kind == "iban":
        body = draw.like(normal[4:])
        return f"{normal[:2]}{98 - iban_remainder(normal[:2] + '00' + body):02d}{body}"
    if kind == "ip":
        sizes = [min(3, len(x) + wider) for x in normal.split(".")]
        return ".".join(str(10 ** (n - 1) + draw.below({1: 9, 2: 90, 3: 155}[n])) for n in sizes)
    if kind == "phone":
        keep = max(0, len(normal) - 10)
        return normal[:keep] + str(2 + draw.below(8)) + draw.like(normal[keep + 1:] + "0" * wider)
    if kind == "ssn":
        return f"9{draw.below(10)}{draw.below(10)}{draw.below(99) + 1:02d}{draw.below(9999) + 1:04d}" + draw.like("0" * wider)
    if kind == "secret":
        return draw.like(normal)
    script = script_of(normal)
    if kind == "family":
        parts = SYLLABLES[script]
        return "".join(parts[draw.below(len(parts))] for _ in range(3 + attempt // 2))
    pool = GIVEN[script, kind[-1]]
    name = pool[draw.below(len(pool))].lower()
    if attempt:  # a pool is small: further draws add a second name, then more
        parts = SYLLABLES[script]
        name += "-" + "".join(parts[draw.below(len(parts))] for _ in range(2 + attempt // 2))
    return name


def in_format(kind: str, value: str, new: str) -> str:
    """The replacement in the punctuation and case of the mention."""
    if kind in ("card", "phone", "ssn", "iban"):
        left = iter(new)
        return "".join([*(next(left, "") if c.isalnum() else c for c in value), *left])
    if kind == "email" and value == value.upper():
        return new.upper()
    if kind == "family" or kind.startswith("given"):
        return new.upper() if value.isupper() and len(value) > 1 else "-".join(p.capitalize() for p in new.split("-"))
    return new


def space_of(kind: str) -> str:
    """Given names of all genders are one kind of entity."""
    return "given" if kind.startswith("given") else kind


def replace(text: str, names: dict[tuple[str, str], str]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, normal in find(text):
        new = names.get((space_of(kind), normal))
        if new is not None:
            out += [text[at:start], in_format(kind, text[start:end], new)]
            at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def sealed(df: DataFrame, name: str) -> DataFrame:
    """A stored step whose entities are encrypted in the shared folder under a key of this call, never kept."""
    key = F.lit(os.urandom(32))
    hidden = stored(df.withColumn("entity", F.aes_encrypt(F.col("entity").cast("binary"), key)), name)
    return hidden.withColumn("entity", F.aes_decrypt("entity", key).cast("string"))


def mentions(docs: DataFrame) -> DataFrame:
    """Distinct (id, h, kind, entity) of the rows (id, h, text)."""
    def run(batches):
        for pdf in batches:
            rows = {(i, h, k, e) for i, h, t in zip(pdf["id"], pdf["h"], pdf["text"], strict=True)
                    for _, _, k, e in find(t)}
            yield pd.DataFrame(sorted(rows), columns=["id", "h", "kind", "entity"])

    return docs.select("id", "h", "text").mapInPandas(run, "id string, h long, kind string, entity string")


def surrogates(entities: DataFrame, key: bytes = KEY) -> DataFrame:
    """(kind, entity, surrogate) without collisions for distinct (kind, entity) rows.

    Rounds go on until no surrogate is shared and none is a known entity; of those that share one, the first entity keeps it.
    A given name met under several genders is one entity: a gender holds if no other one is met, ``given-n`` says nothing.
    """
    def run(batches):
        for pdf in batches:
            pdf["surrogate"] = [surrogate(key, *r) for r in zip(pdf["kind"], pdf["entity"], pdf["attempt"], strict=True)]
            yield pdf

    schema = "kind string, entity string, attempt int, surrogate string"
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    genders = F.array_remove(F.collect_set("kind"), "given-n")
    given = (entities.where(F.col("kind").startswith("given")).groupBy("entity").agg(genders.alias("g"))
             .select(F.when(F.size("g") == 1, F.col("g")[0]).otherwise("given-n").alias("kind"), "entity"))
    domains = (entities.where("kind = 'email'").select(F.lit("domain").alias("kind"),
                                                            F.substring_index("entity", "@", -1).alias("entity")).distinct())
    drawn = entities.where(~F.col("kind").startswith("given")).select("kind", "entity").unionByName(given).unionByName(domains)
    known = drawn.select(space.alias("space"), F.col("entity").alias("surrogate"), F.lit(True).alias("real"))
    rows = sealed(drawn.select("kind", "entity", F.lit(0).alias("attempt")).mapInPandas(run, schema), "pii-surrogates")
    while True:
        spaced = rows.withColumn("space", space)
        first = spaced.groupBy("space", "surrogate").agg(F.min("entity").alias("keeper"), F.count(F.lit(1)).alias("n"))
        taken = first.join(known, ["space", "surrogate"], "left").where((F.col("n") > 1) | F.col("real"))
        judged = spaced.join(taken, ["space", "surrogate"], "left").select(
            "kind", "entity", "attempt", "surrogate",
            (F.coalesce("real", F.lit(False)) | (F.coalesce("keeper", "entity") != F.col("entity"))).alias("again"))
        if judged.where("again").isEmpty():
            break
        redrawn = (judged.where("again").select("kind", "entity", (F.col("attempt") + 1).alias("attempt"))
                   .mapInPandas(run, schema))
        rows = sealed(judged.where("not again").drop("again").unionByName(redrawn), "pii-surrogates")
    final = rows.select("kind", "entity", "surrogate")
    mail = final.where("kind = 'email'").withColumn("_d", F.substring_index("entity", "@", -1))
    hosts = final.where("kind = 'domain'").select(F.col("entity").alias("_d"), F.col("surrogate").alias("_s"))
    whole = mail.join(hosts, "_d").select("kind", "entity", F.concat(
        F.substring_index("surrogate", "@", 1), F.lit("@"), "_s").alias("surrogate"))
    return final.where("kind not in ('email', 'domain')").unionByName(whole)


def with_surrogates(docs: DataFrame, key: bytes = KEY, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in ``text``; other columns and all rows are kept.  ``count`` names a column for the number
    of replaced mentions.

    A null or empty text stays; a long one is handled whole, in time that grows with its length.  Rows repeated in doc_id
    and text are replaced alike; equal doc_ids with other texts are told apart by a hash of the text.  A null doc_id is allowed.  Given the key, results do not depend on partitions.  A table that
    has a column named like ``count`` gets a new one in its place.
    """
    docs = docs.drop(count) if count else docs
    # The row travels whole, so its column names can't clash with those used here.
    packed = docs.select(F.struct(*columns_of(docs)).alias("row"), "text", may_hold(F.col("text")).alias("maybe"),
                         F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.xxhash64("text").alias("h"))
    marked = packed.where("maybe")
    found = sealed(mentions(marked), "pii-mentions").distinct()
    names = surrogates(found.select("kind", "entity").distinct(), key)
    space = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind")).alias("kind")
    own = (found.select("id", "h", space, "entity").distinct()
           .join(names.select(space, "entity", "surrogate"), ["kind", "entity"]).groupBy("id", "h")
           .agg(F.collect_list(F.struct("kind", "entity", "surrogate")).alias("names")))
    joined = marked.join(own, ["id", "h"], "left").select("row", "text", "names")

    def run(batches):
        for batch in batches:
            new, number = [], []
            for text, rows in zip(batch.column("text").to_pylist(), batch.column("names").to_pylist(), strict=True):
                t, k = (text, 0) if rows is None else replace(
                    text, {(r["kind"], r["entity"]): r["surrogate"] for r in rows})
                new.append(t)
                number.append(k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(new, pa.string()), pa.array(number, pa.int32())], names=["row", "text", "n"])

    schema = joined.select("row", "text").withColumn("n", F.lit(0)).schema
    rest = packed.where("not maybe").select("row", "text", F.lit(0).alias("n"))
    out = rest.unionByName(joined.mapInArrow(run, schema))
    columns = [F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns]
    return out.select(*columns, *([F.col("n").alias(count)] if count else []))


def op7_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_surrogates(docs, count="n_replaced").select("doc_id", "n_replaced", "text")
