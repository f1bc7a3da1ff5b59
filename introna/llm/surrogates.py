"""Keyed surrogates for personal data.

Detected entities (mail addresses, phone, card, social-security and account numbers, network addresses,
secrets, names after a title) are replaced by invented ones of the same type, length, script, letter case
and, for names, gender. A surrogate depends on the key, the type and the canonical form of the entity, so
one entity has one surrogate wherever it occurs.

Names: every part of a name is an entity of its own, with one surrogate whatever its title, its place in
the name and its letter case. Its gender is that of the titles before it in the whole corpus (none where
they disagree). Inside a document, capitalised repeats without a title are replaced as well. Initials
become other initials, which need not be distinct; particles stay.

Distinctness: numbers and addresses of a format are a finite space, which a keyed permutation without
fixed points maps onto itself: different entities differ and none stays, however full the space is, with
no look at the corpus. A number's surrogate may thus be another number that is in use. Names, mail
addresses and secrets are drawn; of those that would share a surrogate, or whose surrogate is itself an
entity of the corpus, all but the first try again, with more and more letters, until no two meet.

Not entities: numbers of a card's length that fail the card check digit, addresses with a part over 255.

Defined results: a null text stays null, an empty one empty; texts without entities are unchanged; texts
of any length are searched whole; repeated rows give equal results; other columns pass through, whatever
their names, but for ``n_entities``, which is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import hmac
import math
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from introna.llm.common import stored

KEY = "surrogates"
BROADCAST_RETRIES = 50_000  # entities that needed another try and may be broadcast (some 100 bytes each)
LONGER_AFTER = 8  # tries before a surrogate grows by one character a try
FEISTEL_ROUNDS = 8
FINITE = ("ip", "card", "phone", "ssn", "iban")

# Titles by gender, and the letters invented names are made of.
MALE = "Mr Mister Sir Herr Monsieur Señor Sr Господин".split()
FEMALE = "Mrs Ms Miss Madam Frau Madame Mme Mlle Mademoiselle Señora Sra Señorita Srta Госпожа".split()
NEUTRAL = "Dr Prof Professor Doctor Doktor Доктор".split()
SCRIPTS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "nrsldt"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "нрлдт"),
    "greek": ("βγδζκλμνπρστ", "αειου", "α", "ς"),
}

#: titles that are no other word in lower case
LOWERED = "Mr Mrs Ms Herr Frau Monsieur Madame Mme Mlle Mademoiselle Señor Señora Señorita Dr Prof Господин Госпожа Доктор".split()
TITLES = sorted({*MALE, *FEMALE, *NEUTRAL, *(t.upper() for t in (*MALE, *FEMALE, *NEUTRAL)), *(t.lower() for t in LOWERED)}, key=lambda t: (-len(t), t))
_TITLE = "(?:" + "|".join(TITLES) + r")\.?"
TITLE = rf"(?P<title>\b{_TITLE}(?:[ \u00a0]{_TITLE})*)[ \u00a0]"
INITIALS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: names: parts that begin with a capital, initials, and lower-case particles before a part, without a cap;
#: in scripts without case all words of the script up to another sign
LOWER = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.islower())
CASELESS = "".join(c for c in map(chr, range(0x590, 0x10000)) if c.isalpha() and not c.islower() and not c.isupper() and not c.istitle())
UPPER = rf"[^\W\d_{LOWER}{CASELESS}]"
PARTICLES = "von van de del della der den di da dos das du la le los las zu zum zur bin ibn bint al el ter ten te af av y e".split()
PART = rf"(?:[^\W\d_]['’](?={UPPER}))?{UPPER}[^\W\d_]+(?:[-'’][^\W\d_]+)*"
INITIAL = rf"{UPPER}(?:\.[ -]?| (?={UPPER}))"
PARTICLE = "(?:" + "|".join(PARTICLES) + ")"
NAME = rf"(?:(?:{INITIAL}|{PARTICLE} )*+{PART}(?: (?:{INITIAL}|{PARTICLE} )*+{PART})*|[{CASELESS}][^\W\d_]+(?: [{CASELESS}][^\W\d_]+)*)"
SECRET = r"""(?:"(?P<quoted>(?:[^"\\\n]|\\.)+)"|'(?P<single>(?:[^'\\\n]|\\.)+)'|["']?(?P<bare>(?:[^\s"'&,;]|[&,;](?!\w+=)|["'](?=\w))*(?:[^\W_])[_\-+/=$%*#@^~|&]*))"""
PATTERNS = {
    "mail": r"(?<![\w.+%-])[\w.+%-]*[\w+]@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+",
    "secret": r"(?i:(?<![^\W_])(?:api[_-]?key|access[_-]?key|secret(?:[_-]?key)?|auth[_-]?token|token|password|passwd|pwd)\b)[\"']?\s*(?::=|=>|[:=](?!=))\s*" + SECRET,
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)",
    "card": r"(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\d-])",
    "phone": r"(?<![\w+.])(?:\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}|\+(?!1[ .(-])\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,7}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?![\d-]|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "name": TITLE + rf"(?P<name>{NAME})",
}
#: every digit of re's \d; Arrow's \d and \b know ASCII only
DIGITS = "".join(chr(c) for c in range(sys.maxunicode + 1) if chr(c).isdecimal())
#: what every match of FINDER holds; texts without it are not searched
SUSPECT = f"[@:={DIGITS}]|(?:^|[^\\pL])(?:" + "|".join(TITLES) + ")\\.?[ \u00a0]"
FINDER = re.compile("|".join(f"(?P<is_{kind}>{p})" for kind, p in PATTERNS.items()))
MALE_KEYS, FEMALE_KEYS = ({t.lower() for t in titles} for titles in (MALE, FEMALE))
NAME_PIECE = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")


def card_sum(digits: str) -> int:
    """Check sum of a card number; 0 if valid."""
    doubled = [int(d) for d in digits[-2::-2]]
    return (sum(int(d) for d in digits[-1::-2]) + sum(2 * d - 9 * (d > 4) for d in doubled)) % 10


def iban_rest(value: str) -> int:
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97


def find(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, canonical form, detail) of every entity in order; a name's parts one by one.

    Detail is the gender told by a name's title for its given names: m, f or nothing.
    """
    found = list(_found(text))
    names = {canonical for _, _, kind, canonical, _ in found if kind == "name"}
    if names:
        ends = [e[1] for e in found]
        for part in NAME_PIECE.finditer(text):
            if part[0].lower() in names and part[0][0].lower() != part[0][0] or part[0] in names and part[0].upper() == part[0]:
                i = bisect.bisect_right(ends, part.start())
                if i == len(ends) or found[i][0] >= part.end():
                    found.insert(i, (*part.span(), "name", part[0].lower(), ""))
                    ends.insert(i, part.end())
    return found


def _found(text: str) -> Iterator[tuple[int, int, str, str, str]]:
    at = 0
    while m := FINDER.search(text, at):
        kind = m.lastgroup[3:] if m.lastgroup.startswith("is_") else next(k for k in PATTERNS if m[f"is_{k}"])
        start, end = m.span()
        value = m[0]
        if kind == "phone":
            # the groups that E.164 has room for; what follows them is another number
            while sum(c.isdecimal() for c in value) > 15 and (cut := re.search(r"[ .-]\d+$", value)):
                value, end = value[: cut.start()], start + cut.start()
        at = end
        if kind == "secret":
            start, end = next(m.span(g) for g in ("quoted", "single", "bare") if m[g])
            if any(c.isalpha() or c.isdecimal() for c in text[start:end]):
                yield start, end, kind, text[start:end], ""
        elif kind == "name":
            titles = {t.rstrip(".").lower() for t in re.split("[ \u00a0]", m["title"])}
            gender = "m" if titles & MALE_KEYS else "f" if titles & FEMALE_KEYS else ""
            parts = [p for p in NAME_PIECE.finditer(text, *m.span("name")) if p[0] not in PARTICLES]
            last = max((i for i, p in enumerate(parts) if len(p[0]) > 1), default=0)
            for i, part in enumerate(parts):
                kind = "initial" if len(part[0]) == 1 and part[0].lower() != part[0].upper() else "name"
                yield *part.span(), kind, part[0].lower(), gender if kind == "name" and i < last else ""
        elif kind == "ip":
            if all(int(x) < 256 for x in value.split(".")):
                yield start, end, kind, ".".join(str(int(x)) for x in value.split(".")), ""
        elif kind == "card":
            digits = re.sub(r"\D", "", value)
            if card_sum(digits) == 0:
                yield start, end, kind, digits, ""
        elif kind == "iban":
            flat = value.replace(" ", "")
            if 15 <= len(flat) <= 34 and iban_rest(flat) == 1:
                yield start, end, kind, flat, ""
        elif kind == "mail":
            yield start, end, kind, value.lower(), ""
        else:
            yield start, end, kind, re.sub(r"[^\d+]", "", value), ""


class Draw:
    """Keyed choices."""

    def __init__(self, key: str, *parts: str):
        self.seed = hmac.new(key.encode(), "\x1f".join(parts).encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, n: int) -> int:
        if len(self.pool) < 8:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        value, self.pool = int.from_bytes(self.pool[:8], "big"), self.pool[8:]
        return value % n

    def of(self, items):
        return items[self.below(len(items))]


def script_of(word: str) -> str:
    c = ord(next((x for x in word if x.isalpha()), "a"))
    return "cyrillic" if 0x400 <= c < 0x530 else "greek" if 0x370 <= c < 0x400 else "latin" if c < 0x250 or 0x1E00 <= c < 0x1F00 else "other"


@functools.lru_cache(1024)
def _block(start: int) -> str:
    """Letters of a block of 128 code points that are not capitals."""
    return "".join(x for x in map(chr, range(start, start + 128)) if x.isalpha() and x.lower() == x)


def letters_like(word: str) -> str:
    """The alphabet of the word's script: a script of its own is known by the block of its first letter."""
    script = script_of(word)
    c = next((x for x in word.lower() if x.isalpha()), "a")
    return INITIALS[script] if script in INITIALS else _block(ord(c) & ~0x7F) or c


def shaped(draw: Draw, value: str) -> str:
    """Letters for letters of the same case, digits for digits, the rest as it is."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    return "".join(
        draw.of("0123456789") if c.isdecimal() else draw.of(letters.upper() if c.isupper() else letters) if c.isalpha() else c for c in value
    )


def permuted(key: str, space: str, index: int, size: int) -> int:
    """Another number below ``size``: a keyed permutation without fixed points.

    A Feistel network, walked until it is back in range, is a permutation p; the inverse of p, after a step
    of one, after p moves every number and no two to the same.
    """
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    width = (half + 7) // 8
    mask, secret = (1 << half) - 1, hashlib.sha256(f"{key}\x1f{space}\x1f{size}".encode()).digest()

    def mixed(i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(x.to_bytes(width, "big"), digest_size=min(width, 64), key=secret, salt=bytes([i])).digest(), "big") & mask

    def walked(x: int, forward: bool) -> int:
        while True:
            left, right = x >> half, x & mask
            for i in range(FEISTEL_ROUNDS):
                if forward:
                    left, right = right, left ^ mixed(i, right)
                else:
                    left, right = right ^ mixed(FEISTEL_ROUNDS - 1 - i, left), left
            x = left << half | right
            if x < size:
                return x

    return walked((walked(index, True) + 1) % size, False)


#: private and special networks: first address and prefix length
NETWORKS = ((10 << 24, 8), (127 << 24, 8), (172 << 24 | 16 << 16, 12), (192 << 24 | 168 << 16, 16))


def _ip_class(n: int) -> int:
    """Number of the network an address belongs to; public ones and the ranges from 224 and of 0 are classes of their own."""
    for i, (first, length) in enumerate(NETWORKS):
        if n >> (32 - length) == first >> (32 - length):
            return i
    return len(NETWORKS) + (n >> 24 >= 224 or n >> 24 == 0)


def _of_space(key: str, kind: str, canonical: str) -> str:
    """Surrogate of a number or address: another one of its format."""
    if kind == "ip":
        n = sum(int(x) << (24 - 8 * i) for i, x in enumerate(canonical.split(".")))
        own = _ip_class(n)
        first, length = NETWORKS[own] if own < len(NETWORKS) else (0, 0)
        size, n = 1 << (32 - length), n - first
        n = permuted(key, f"ip{own}", n, size)
        while own >= len(NETWORKS) and _ip_class(n) != own:
            n = permuted(key, f"ip{own}", n, size)
        return ".".join(str((first + n) >> shift & 255) for shift in (24, 16, 8, 0))
    if kind == "iban":
        radix = [10 if c.isdecimal() else 26 for c in canonical[4:]]
        n = 0
        for c, r in zip(canonical[4:], radix):
            n = n * r + (int(c) if r == 10 else ord(c) - 65)
        n = permuted(key, f"iban{canonical[:2]}{''.join('d' if r == 10 else 'l' for r in radix)}", n, math.prod(radix))
        body = []
        for r in reversed(radix):
            n, rest = divmod(n, r)
            body.append(str(rest) if r == 10 else chr(65 + rest))
        text = "".join(reversed(body))
        return f"{canonical[:2]}{98 - iban_rest(canonical[:2] + '00' + text):02d}{text}"
    # a card keeps its first digit and gets its check digit, an international number keeps its first digit
    kept = 1 if kind == "card" else 2 if canonical.startswith("+") else 0
    digits = canonical[kept:-1] if kind == "card" else canonical[kept:]
    made = canonical[:kept] + str(permuted(key, f"{kind}{canonical[:kept]}{len(digits)}", int(digits), 10 ** len(digits))).zfill(len(digits))
    return next(made + d for d in "0123456789" if card_sum(made + d) == 0) if kind == "card" else made


def surrogate(key: str, kind: str, canonical: str, detail: str, attempt: int) -> str:
    """Canonical form of the surrogate; ``detail`` is a name's gender."""
    if kind in FINITE:
        return _of_space(key, kind, canonical)
    draw = Draw(key, kind, canonical, str(attempt))
    longer = max(0, attempt - LONGER_AFTER)
    extra = "".join(draw.of("abcdefghijklmnopqrstuvwxyz") for _ in range(longer))
    if kind == "initial":
        return draw.of([c for c in letters_like(canonical) if c != canonical] or [canonical])
    if kind in ("name", "given", "family"):
        if script_of(canonical) == "other":
            letters = letters_like(canonical)
            return "".join(draw.of(letters) for _ in range(max(len(canonical), 1) + longer))
        consonants, vowels, female, male = SCRIPTS[script_of(canonical)]
        stem = "".join(draw.of(consonants) + draw.of(vowels) for _ in range(2 + (len(canonical) > 6) + longer))
        return stem[:-1] + female if detail == "f" else stem + draw.of(male)
    if kind == "mail":
        local, _, domain = canonical.rpartition("@")
        host, _, top = domain.rpartition(".")
        return f"{shaped(draw, local)}{extra}@{shaped(Draw(key, 'host', host), host)}.{top}"
    for digits in ("0123456789abcdef", "0123456789ABCDEF"):
        if kind == "secret" and set(canonical) <= set(digits):
            return "".join(draw.of(digits) for _ in range(len(canonical) + longer))
    return shaped(draw, canonical) + (extra if kind == "secret" else "")


def fitted(kind: str, original: str, value: str) -> str:
    """The surrogate in the outer form of the original: separators, and letter case."""
    if kind in ("phone", "card", "iban", "ssn"):
        it = iter(value.replace("+", ""))
        return "".join(next(it) if c.isalnum() else c for c in original)
    if kind in ("ip", "secret"):
        return value
    if kind in ("initial", "name"):
        return value.upper() if original.isupper() and len(original) > 1 else value[:1].upper() + value[1:]
    return value.upper() if original.isupper() else value


def _suspects(texts: pa.Array) -> list[bool]:
    return pc.fill_null(pc.match_substring_regex(texts, SUSPECT), False).to_pylist()


def entities(docs: DataFrame) -> DataFrame:
    """(kind, canonical, detail) of every entity of the corpus, once."""

    def run(batches):
        for batch in batches:
            texts = batch.column("text")
            found = {e[2:] for text, is_suspect in zip(texts, _suspects(texts)) if is_suspect for e in find(text.as_py()) if e[2] != "initial"}
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], ["kind", "canonical", "detail"])

    return docs.select("text").mapInArrow(run, "kind string, canonical string, detail string").distinct()


def gender_of(found: DataFrame) -> DataFrame:
    """Add ``resolved``: a name's gender over the whole corpus, where its titles agree."""
    told = found.groupBy("kind", "canonical").agg(F.min(F.nullif("detail", F.lit(""))).alias("low"), F.max(F.nullif("detail", F.lit(""))).alias("high"))
    one = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise(F.lit(""))
    return found.join(told.select("kind", "canonical", one.alias("resolved")), ["kind", "canonical"])


def assign(found: DataFrame, key: str = KEY) -> DataFrame:
    """Add ``attempt`` and ``surrogate``, so that no two entities of a kind share one and none is an entity itself."""

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "canonical", "detail", "attempt")))
            made = pa.array([surrogate(key, *r) for r in rows], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "surrogate"])

    schema = "kind string, canonical string, detail string, attempt int, surrogate string"
    now = stored(found.withColumn("attempt", F.lit(0)).mapInArrow(run, schema), "surrogates")
    while True:  # surrogates that try again grow, so there is room for all
        taken = found.select("kind", F.col("canonical").alias("surrogate")).distinct().withColumn("real", F.lit(True))
        order = Window.partitionBy("kind", "surrogate").orderBy("attempt", "canonical", "detail")
        checked = now.join(taken, ["kind", "surrogate"], "left").withColumn("again", F.col("real").isNotNull() | (F.row_number().over(order) > 1)).drop("real")
        checked = stored(checked, "surrogates-checked")
        if not checked.where("again").count():
            return checked.drop("again")
        retried = checked.where("again").select("kind", "canonical", "detail", (F.col("attempt") + 1).alias("attempt")).mapInArrow(run, schema)
        now = stored(checked.where("not again").select(*now.columns).unionByName(retried), "surrogates")


def exceptions(docs: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, canonical, detail, attempt, resolved) of the entities whose surrogate does not follow from the place alone."""
    found = stored(entities(docs).where(~F.col("kind").isin(*FINITE)), "entities")
    gendered = stored(gender_of(found), "entities-gendered")
    tried = assign(gendered.select("kind", "canonical", F.col("resolved").alias("detail")).distinct(), key).where("attempt > 0")
    tries = tried.select("kind", "canonical", "attempt")
    joined = gendered.join(tries, ["kind", "canonical"], "left").withColumn("attempt", F.coalesce("attempt", F.lit(0)))
    return joined.where("attempt > 0 or resolved <> detail").select("kind", "canonical", "detail", "attempt", "resolved")


def _rewrite(text: str, key: str, known: dict[tuple[str, str, str], tuple[int, str]]) -> tuple[str, int]:
    out, at, n = [], 0, 0
    for start, end, kind, canonical, detail in find(text):
        attempt, gender = known.get((kind, canonical, detail), (0, detail))
        value = surrogate(key, kind, canonical, gender, attempt)
        out += [text[at:start], fitted(kind, text[start:end], value)]
        at, n = end, n + 1
    return "".join([*out, text[at:]]), n


def replace(docs: DataFrame, key: str = KEY) -> DataFrame:
    """``docs`` with surrogates in ``text``, and ``n_entities``.

    Texts are not shuffled: nearly every surrogate follows from its entity alone. Only entities that needed
    another try, and names whose gender another place tells, are looked up, from a broadcast where they are
    few (counted), else by a join on doc_id.
    """
    retried = stored(exceptions(docs, key), "retried")
    names = [c for c in docs.columns if c != "n_entities"]
    schema = T.StructType([docs.schema[c] for c in names] + [T.StructField("n_entities", T.LongType())])
    if retried.count() <= BROADCAST_RETRIES:
        few = {(r["kind"], r["canonical"], r["detail"]): (r["attempt"], r["resolved"]) for r in retried.collect()}
        shared = docs.sparkSession.sparkContext.broadcast(few)

        def run(batches):
            for batch in batches:
                texts = batch.column("text")
                done = [_rewrite(t.as_py(), key, shared.value) if s else (t.as_py(), 0) for t, s in zip(texts, _suspects(texts))]
                yield _with(batch, names, done)

        return docs.select(*names).mapInArrow(run, schema)

    def occurrences(batches):
        for batch in batches:
            texts = batch.column("text")
            rows = {(i.as_py(), *e[2:]) for i, t, s in zip(batch.column("doc_id"), texts, _suspects(texts)) if s for e in find(t.as_py())}
            columns = list(zip(*rows)) or [(), (), (), ()]
            kinds = [batch.schema.field("doc_id").type, pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["doc_id", "kind", "canonical", "detail"])

    keyed = docs.select("doc_id", "text")
    where = keyed.mapInArrow(occurrences, T.StructType([keyed.schema["doc_id"], *(T.StructField(c, T.StringType()) for c in ("kind", "canonical", "detail"))]))
    tries = where.join(retried, ["kind", "canonical", "detail"]).groupBy("doc_id").agg(F.to_json(F.collect_set(F.struct("kind", "canonical", "detail", "attempt", "resolved"))).alias("tries"))
    own_name = "_tries"
    while own_name in names:
        own_name += "_"
    rows = docs.select(F.struct(*(F.col(f"`{n}`") for n in names)).alias("row"), "doc_id")
    met = rows.join(tries.withColumnRenamed("doc_id", "id"), F.col("doc_id").eqNullSafe(F.col("id")), "left")
    joined = met.select("row.*", F.col("tries").alias(own_name))

    def run_joined(batches):
        import json

        for batch in batches:
            texts = batch.column("text")
            done = []
            for t, s, j in zip(texts, _suspects(texts), batch.column(own_name)):
                own = {(x["kind"], x["canonical"], x["detail"]): (x["attempt"], x["resolved"]) for x in json.loads(j.as_py() or "[]")} if s else {}
                done.append(_rewrite(t.as_py(), key, own) if s else (t.as_py(), 0))
            yield _with(batch, names, done)

    return joined.mapInArrow(run_joined, schema)


def _with(batch: pa.RecordBatch, names: list[str], done: list[tuple[str | None, int]]) -> pa.RecordBatch:
    texts, counts = pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64())
    return pa.RecordBatch.from_arrays([*(texts if n == "text" else batch.column(n) for n in names), counts], [*names, "n_entities"])
