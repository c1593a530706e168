"""Personal data replaced by keyed surrogates of the same type and form.

Entities are e-mail addresses, telephone, card and social-security numbers, IPv4 addresses, secrets, and names that a title
announces. A surrogate is drawn from a keyed hash of the entity's normal form, so every mention of an entity, in any document
and any spelling, gets the same one, and it keeps what the mention shows: separators, letter case, digits for digits, a valid
check digit, the title's gender, the script of a name.

Collisions are looked for among all entities of the corpus: if two share a surrogate, or a surrogate is somebody's real value,
the later one is drawn again. Only entities that had to be drawn again are remembered; texts are rewritten where they lie.

Defined cases: null texts stay null and empty ones empty, without entities; repeated rows are rewritten each; documents without
an entity are returned unchanged; other columns stay, and columns named as an output are replaced.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortline.functions.sizing import cut_lineage, drop_cut
from cohortline.llm.common import WordCache, appended, arrow_schema, free_name, released, sliced

#: Entities drawn again, well below 200 bytes each, that are sent to all tasks; more are joined to their documents.
BROADCAST_REDRAWN = 100_000
#: Draws of one entity before its surrogate grows by a character at each further one.
SAME_LENGTH_DRAWS = 6

EMAIL = re.compile(r"[\w.+-]*[\w+-]@(?:[\w-]+\.)+[^\W\d_]{2,}")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)")
CARD = re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?![\w-]|\.\d)")
SSN = re.compile(r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-]|\.\d)")
PHONE = re.compile(r"(?<![\w.])(?:(?:\+\d{1,3}[ .-]?)?\(\d{3}\)[ .-]?\d{3}[ .-]?\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\w-])"
                   r"|(?<![\w.-])(?<!\d )(?:\d{3} \d{3} \d{4}|0\d{2,4} \d{3,4} \d{3,4})(?![\w-]| \d)")
#: Account numbers: country, check digits, and groups or one run; only those whose check digits are right.
IBAN = re.compile(r"(?<![\w-])[A-Z]{2}\d{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})(?![\w-])")
#: Other international numbers; a last group too many belongs to what follows.
ABROAD = re.compile(r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{1,4}(?:[ .-]?\d{2,4}){1,5}(?![\w-])")
LAST_GROUP = re.compile(r"[ .-]?\d{2,4}$")
SECRET = re.compile(r"""\b(?:token|secret|password|passwd|api[_-]?key|access[_-]?key)["']?\s*[=:]\s*["']?([A-Za-z0-9+/_-]{8,}={0,2})""", re.IGNORECASE)
KEY = re.compile(r"\b(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,})\b")

#: Titles with the gender they show.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "n", "Prof": "n", "Herr": "m", "Herrn": "m", "Frau": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Don": "m", "Doña": "f",
    "господин": "m", "госпожа": "f", "κύριος": "m", "κυρία": "f",
}
TITLE = re.compile("|".join(map(re.escape, TITLES)), re.IGNORECASE)
#: A capital and more letters, with hyphens, apostrophes and capitals inside: Jean-Luc, O'Brien, McDonald.
WORD = r"[^\W\d_a-z][^\W\d_]*(?:['’-][^\W\d_]+)*"
#: A title, initials that stay, and up to three words of a name.
NAME = re.compile(r"\b(" + "|".join(sorted((re.escape(t) for x in TITLES for t in {x, x.upper()}), key=len, reverse=True))
                  + rf")\b\.?[  ](?:[^\W\d_a-z]\.[  ]?)*({WORD})(?:[  ]({WORD}))?(?:[  ]({WORD}))?")
#: Sounds for drawn names: consonants, vowels, and endings for men and women.
SOUNDS = {
    "LATIN": ("bdfglmnrstvk", "aeiou", ("n", "s", "r", "k"), ("a", "ia", "ina")),
    "CYRILLIC": ("бвгдклмнрст", "аеиоу", ("н", "р", "й", "в"), ("а", "ия", "ина")),
    "GREEK": ("βγδκλμνρστ", "αειο", ("ς", "ης", "ος"), ("α", "ια", "η")),
}


class Mention(NamedTuple):
    start: int
    stop: int
    kind: str
    norm: str


def _digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def luhn(digits: str) -> bool:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def iban_check(text: str) -> int:
    """The remainder modulo 97 of an account number whose country and check digits go last; 1 if they are right."""
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def script(word: str) -> str:
    for c in word:
        name = unicodedata.name(c, "")
        if c.isalpha():
            return next((s for s in SOUNDS if name.startswith(s)), "LATIN")
    return "LATIN"


def _is_name(word: str, shouted: bool) -> bool:
    """Two letters or more beginning with a capital; all capitals only after a title in capitals."""
    return len(word) > 1 and word[0].isupper() and (shouted or any(c.islower() for c in word))


def _names(text: str) -> Iterator[Mention]:
    known: dict[str, str] = {}
    for m in NAME.finditer(text):
        title = m[1] if m[1] in TITLES else next(t for t in TITLES if t.upper() == m[1])
        shouted = m[1].isupper() and len(m[1]) > 1
        words = []
        for group in (2, 3, 4):
            if m[group] is None or not _is_name(m[group], shouted):
                break
            words.append(group)
        for group in words:
            word = m[group]
            kind = f"given-{TITLES[title]}-{script(word)}" if group == 2 and len(words) > 1 else f"family-{script(word)}"
            yield Mention(*m.span(group), known.setdefault(word.casefold(), kind), word.casefold())
    if known:  # mentions of the same words without a title, also in capitals
        spelt = {w for x in known for w in (x, x.upper())}
        for m in re.finditer(r"(?<![^\W\d_])(?:" + "|".join(sorted(map(re.escape, spelt), key=len, reverse=True)) + r")(?![^\W\d_])", text, re.IGNORECASE):
            if m[0][0].isupper():
                yield Mention(*m.span(), known[m[0].casefold()], m[0].casefold())


def _abroad(text: str) -> Iterator[Mention]:
    for m in ABROAD.finditer(text):
        value = m[0]
        while len(_digits(value)) > 15:
            value = LAST_GROUP.sub("", value)
        if len(_digits(value)) >= 7:
            yield Mention(m.start(), m.start() + len(value), "phone", "+" + _digits(value))


def _hidden(text: str, found: list[Mention]) -> str:
    """The text with blanks, of no use to any pattern, where something has been found."""
    for m in found:
        text = f"{text[:m.start]}{chr(0) * (m.stop - m.start)}{text[m.stop:]}"
    return text


def mentions(text: str | None) -> list[Mention]:
    """Entities in order of place, without overlaps: each kind is looked for in what the kinds before it have left."""
    if not text:
        return []
    out: list[Mention] = []
    left = text

    def take(some: Iterable[Mention]) -> None:
        nonlocal left
        if new := list(some):
            out.extend(new)
            left = _hidden(left, new)

    if "@" in text:
        take(Mention(*m.span(), "email", m[0].lower()) for m in EMAIL.finditer(left))
    if "=" in text or ":" in text:
        take(Mention(*m.span(1), "secret", m[1].lower() if re.fullmatch("[0-9a-fA-F]+", m[1]) else m[1]) for m in SECRET.finditer(left))
    if any(d in text for d in "0123456789"):
        take(Mention(*m.span(), "secret", m[0]) for m in KEY.finditer(left))
        plain = ((m, m[0].replace(" ", "")) for m in IBAN.finditer(left))
        take(Mention(*m.span(), "iban", x) for m, x in plain if iban_check(x) == 1)
        take(Mention(*m.span(), "ip", m[0]) for m in IPV4.finditer(left) if all(int(x) < 256 for x in m[0].split(".")))
        take(Mention(*m.span(), "phone", "+" * (m[0][0] == "+") + _digits(m[0])) for m in PHONE.finditer(left))
        take(Mention(*m.span(), "ssn", _digits(m[0])) for m in SSN.finditer(left))
        take(Mention(*m.span(), "card", _digits(m[0])) for m in CARD.finditer(left))
        take(_abroad(left))
    if TITLE.search(text):
        found, end = [], 0
        for m in sorted(_names(left), key=lambda x: (x.start, -x.stop, x.kind)):
            if m.start >= end:
                found.append(m)
                end = m.stop
        take(found)
    return sorted(out)


class Source:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, kind: str, norm: str, attempt: int):
        self.seed, self.block, self.pool = hmac.new(key, f"{kind}\0{attempt}\0{norm}".encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 4:
            self.pool = hashlib.sha256(self.seed + self.block.to_bytes(4, "little")).digest()
            self.block += 1
        value, self.pool = int.from_bytes(self.pool[:4], "little"), self.pool[4:]
        return value % n

    def like(self, text: str) -> str:
        """A digit for a digit and a lower-case letter for a letter; anything else as it is."""
        return "".join(str(self.below(10)) if c.isdigit() else "abcdefghijklmnopqrstuvwxyz"[self.below(26)] if c.isalpha() else c for c in text)


def draw(key: bytes, kind: str, norm: str, attempt: int = 0) -> str:
    """The surrogate of an entity in its normal form."""
    source, more = Source(key, kind, norm, attempt), max(0, attempt - SAME_LENGTH_DRAWS)
    if kind == "email":
        local, _, domain = norm.rpartition("@")
        labels = domain.split(".")
        hosts = Source(key, "host", domain, 0)  # addresses of one host stay together
        return f"{source.like(local + 'a' * more)}@{'.'.join([hosts.like(x) for x in labels[:-1]])}.example"  # a domain nobody can own
    if kind == "ip":
        return ".".join(str(source.below(256)) for _ in range(4))
    if kind == "phone":
        lead = norm[: len(norm) - 10] if norm[0] == "+" and len(norm) > 10 else ""
        return lead + source.like(norm[len(lead):])
    if kind == "card":
        digits = source.like(norm)
        return next(d for d in (digits[:-1] + str(c) for c in range(10)) if luhn(d)) if luhn(norm) else digits
    if kind == "ssn":
        return source.like(norm)
    if kind == "iban":
        own = "".join(str(source.below(10)) if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ"[source.below(26)] for c in norm[4:])
        return f"{norm[:2]}{98 - iban_check(f'{norm[:2]}00{own}'):02d}{own}"
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", norm):
            return "".join("0123456789abcdef"[source.below(16)] for _ in range(len(norm) + more))
        return "".join(x if not x.isalnum() else y.upper() if x.isupper() else y for x, y in zip(norm + "a" * more, source.like(norm + "a" * more), strict=True))
    *_, letters = kind.split("-")
    consonants, vowels, men, women = SOUNDS[letters]
    word = "".join(consonants[source.below(len(consonants))] + vowels[source.below(len(vowels))] for _ in range(3 + more))
    ends = women if "-f-" in kind else men
    return word[:-1] + ends[source.below(len(ends))] if ends is women else word + ends[source.below(len(ends))]


def shaped(surrogate: str, mention: str, kind: str) -> str:
    """The surrogate in the spelling of one mention."""
    if kind in ("phone", "card", "ssn"):
        digits = iter(_digits(surrogate))
        return "".join(next(digits) if c.isdigit() else c for c in mention)
    if kind == "iban":
        letters = iter(surrogate)
        return "".join(c if c == " " else next(letters) for c in mention)
    if kind.startswith(("given", "family")):
        return surrogate.upper() if mention.isupper() else surrogate[0].upper() + surrogate[1:]
    return surrogate.upper() if mention.isupper() else surrogate


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct rows (kind, norm) of the corpus."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text):
            found = sorted({(m.kind, m.norm) for x in batch.column(text).to_pylist() for m in mentions(x)})
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.string()) for i in (0, 1)], names=["kind", "norm"])

    return docs.select(text).mapInArrow(released(run), "kind string, norm string").distinct()


def drawn(rows: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, norm, attempt, surrogate)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c) for c in ("kind", "norm", "attempt")]
            found = [draw(key, *x) for x in zip(*[c.to_pylist() for c in columns], strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found, pa.string())], names=["kind", "norm", "attempt", "surrogate"])

    return rows.select("kind", "norm", "attempt").mapInArrow(released(run), "kind string, norm string, attempt int, surrogate string")


def redrawn(known: DataFrame, key: bytes) -> DataFrame:
    """Rows (kind, norm, attempt) of entities whose first surrogate is taken, with the attempt that is free.

    A surrogate belongs to its earliest attempt, then the smallest normal form; what is settled keeps its surrogate.
    """
    now = cut_lineage(drawn(known.withColumn("attempt", F.lit(0)), key))
    while True:
        owner = now.groupBy("kind", "surrogate").agg(F.min_by("norm", F.struct("attempt", "norm")).alias("owner"), F.count("*").alias("n")).where("n > 1")
        shared = now.join(owner, ["kind", "surrogate"]).where("norm <> owner").select("kind", "norm")
        real = now.select("kind", F.col("norm").alias("surrogate"))
        taken = now.join(real, ["kind", "surrogate"], "left_semi").select("kind", "norm")
        clashing = cut_lineage(shared.union(taken).distinct())
        if clashing.isEmpty():
            drop_cut(clashing)
            return now.where("attempt > 0").select("kind", "norm", "attempt")
        again = drawn(now.join(clashing, ["kind", "norm"], "left_semi").withColumn("attempt", F.col("attempt") + 1), key)
        then = cut_lineage(now.join(clashing, ["kind", "norm"], "left_anti").select("kind", "norm", "attempt", "surrogate").union(again))
        drop_cut(now, clashing)
        now = then


def rewritten(docs: DataFrame, secret: str, text: str = "text", out: str = "entities", broadcast_rows: int = BROADCAST_REDRAWN) -> DataFrame:
    """The documents with entities in ``text`` replaced, and where they now stand in ``out``: an array of (kind, start, stop)."""
    key = secret.encode()
    known = cut_lineage(entities(docs, text))
    again = cut_lineage(redrawn(known, key))
    drop_cut(known)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
    schema = appended(docs.schema, T.StructField(out, T.ArrayType(span), False))
    arrow = arrow_schema(schema)
    column, digest = free_name("_attempts", docs.columns), free_name("_digest", docs.columns)
    if again.limit(broadcast_rows + 1).count() <= broadcast_rows:
        everywhere = {(r["kind"], r["norm"]): r["attempt"] for r in again.collect()}
        source = docs
    else:
        everywhere = {}
        source = docs.withColumn(digest, F.sha2(text, 256)).join(_attempts(docs, again, text, digest, column), digest, "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordCache()
        make = lambda words: [draw(key, *w) for w in words]
        for batch in sliced(batches, text):
            own = batch.column(column).to_pylist() if column in batch.schema.names else [None] * batch.num_rows
            texts, spans = [], []
            for whole, some in zip(batch.column(text).to_pylist(), own, strict=True):
                found = mentions(whole)
                if found:
                    attempts = {(x["kind"], x["norm"]): x["attempt"] for x in some or []} or everywhere
                    new = cache.values([(m.kind, m.norm, attempts.get((m.kind, m.norm), 0)) for m in found], make)
                    parts, at, length, places = [], 0, 0, []
                    for m, surrogate in zip(found, new, strict=True):
                        value = shaped(surrogate, whole[m.start:m.stop], m.kind)
                        parts += [whole[at:m.start], value]
                        length += m.start - at
                        places.append({"kind": m.kind, "start": length, "stop": length + len(value)})
                        length += len(value)
                        at = m.stop
                    texts.append("".join([*parts, whole[at:]]))
                    spans.append(places)
                else:
                    texts.append(whole)
                    spans.append([])
            new = {text: pa.array(texts, pa.string()), out: pa.array(spans, arrow.field(out).type)}
            yield pa.RecordBatch.from_arrays([new[f.name] if f.name in new else batch.column(f.name).cast(f.type) for f in arrow], schema=arrow)

    return source.mapInArrow(released(run), schema)


def _attempts(docs: DataFrame, again: DataFrame, text: str, digest: str, column: str) -> DataFrame:
    """For texts that mention entities drawn again: those entities and their attempts, bounded by the mentions.

    Texts stand for their rows, so that rows without an id and repeated ids find their own.
    """
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            row, found = [], []
            for i, x in enumerate(batch.column("text").to_pylist()):
                some = {(m.kind, m.norm) for m in mentions(x)}
                row += [i] * len(some)
                found += sorted(some)
            columns = [batch.column("digest").take(pa.array(row, pa.int64())), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["digest", "kind", "norm"])

    texts = docs.select(F.sha2(text, 256).alias("digest"), F.col(text).alias("text"))
    each = texts.mapInArrow(released(run), "digest string, kind string, norm string").distinct().join(again, ["kind", "norm"])
    return each.groupBy(F.col("digest").alias(digest)).agg(F.collect_list(F.struct("kind", "norm", "attempt")).alias(column))
