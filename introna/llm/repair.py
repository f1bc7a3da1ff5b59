"""Cheapest repair of conversations by grammar-compressed dynamic programming.

1. Rows get a fault (blank, duplicate, truncated) in DataFrame functions; equal rows are counted before
   any shuffle, and what was seen earlier is told by the first turn of each text, so no task holds a
   conversation.
2. Narrow rows are sorted by range, so even one conversation's rows are dealt over tasks, and read in
   order as pieces: strings of one symbol per row (role initial and fault).
3. Re-Pair finds the pairs of symbols that repeat within a batch of pieces. Every rule has one min-plus
   transfer matrix over the states of the role grammar, the product of those of its two parts; an entry
   is the least cost with an audit rope. Rules and matrices are shared by all conversations of a task.
4. Pieces that hold a whole conversation are done there; the matrices of others are multiplied in order.
5. Texts meet their audits in one shuffle and are repaired as a stream; a digest is taken along it.

Why the ropes compose: at equal cost no audit of the same rows is the beginning of another, as the rest
could only be insertions, which cost. So the least of all whole audits is made of least parts.

The role grammar is ``(s?(ua)+)?``. Defined results: a null role or text reads as one space; rows go by
turn (nulls first), then role, then the digest of the text; roles are known by their first letter, other
letters and empty roles are never kept; a conversation without id is one conversation; of equal rows all
but the first are duplicates; texts of any length are read whole; only the four columns are read, so
further ones and their names do not matter; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from introna.llm.common import stored

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
VISIBLE = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
PIECE = 4096  # rows of a piece at most
RULES = 50_000  # rules a task remembers at a time

STATES = 4  # nothing yet, after system, after user, after assistant
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
INSERTS = {(0, 0): 0, (0, 2): 1, (0, 3): 2, (1, 1): 0, (1, 2): 1, (1, 3): 2, (2, 2): 0, (2, 3): 1, (3, 3): 0, (3, 2): 1}
ACCEPTED = (0, 3)
LEGAL = {"su", "ua", "au"}

Rope = str | tuple  # a text, or the ropes of its two parts
Entry = tuple[int, Rope] | None
Matrix = list[list[Entry]]


# damage and faults

def damage(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role, text after seeded damage: dropped, emptied, cut off, repeated or given the user's role."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(key.cast("binary")) % 20
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    hit = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _filled(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def faults(rows: DataFrame) -> DataFrame:
    """Equal rows as one: conv_id, turn, role, digest, n, and the faults blank, seen (earlier) and truncated."""
    filled = _filled(rows)
    narrow = filled.select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
        (~F.col("text").rlike(VISIBLE)).alias("blank"), (~F.col("text").rlike(ENDED)).alias("truncated"),
    ).groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.count("*").alias("n"))
    first = narrow.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(F.struct("turn")).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return narrow.join(first, same).withColumn("seen", F.struct("turn") > F.col("first")).drop("c", "r", "d", "first")


# ropes and min-plus matrices

def leaves(rope: Rope) -> Iterator[str]:
    open_ = [rope]
    while open_:
        part = open_.pop()
        if isinstance(part, str):
            yield part
        else:
            open_ += (part[1], part[0])


def text_of(rope: Rope) -> str:
    return "".join(leaves(rope))


def before(a: Rope, b: Rope) -> bool:
    """Whether the text of ``a`` sorts before that of ``b``; both are walked leaf by leaf."""
    if isinstance(a, str) and isinstance(b, str):
        return a < b
    left, right = leaves(a), leaves(b)
    x = y = ""
    while True:
        if not x and (x := next((s for s in left if s), "")) == "":
            return bool(y or next((s for s in right if s), ""))
        if not y and (y := next((s for s in right if s), "")) == "":
            return False
        n = min(len(x), len(y))
        if x[:n] != y[:n]:
            return x[:n] < y[:n]
        x, y = x[n:], y[n:]


def cheaper(a: Entry, b: Entry) -> Entry:
    if a is None or b is None:
        return b if a is None else a
    if a[0] != b[0]:
        return a if a[0] < b[0] else b
    return b if before(b[1], a[1]) else a


def joined(a: Rope, b: Rope) -> Rope:
    if not a or not b:
        return a or b
    return a + b if isinstance(a, str) and isinstance(b, str) and len(a) + len(b) < 32 else (a, b)


def times(row: list[Entry], matrix: Matrix) -> list[Entry]:
    out: list[Entry] = [None] * STATES
    for entry, steps in zip(row, matrix):
        if entry is not None:
            for q, step in enumerate(steps):
                if step is not None:
                    out[q] = cheaper(out[q], (entry[0] + step[0], joined(entry[1], step[1])))
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return [times(row, b) for row in a]


def unit(p: int) -> list[Entry]:
    return [(0, "") if q == p else None for q in range(STATES)]


SYMBOLS = "suaoSUAOx"  # a sound row by its role's initial (o: any other), a truncated one, one that has to go


def symbol_matrix(symbol: str) -> Matrix:
    """Insertions before a row, then what is done with the row."""
    closed: Matrix = [[None] * STATES for _ in range(STATES)]
    for (p, q), n in INSERTS.items():
        closed[p][q] = (n * INSERT_COST, INSERT * n)
    own: Matrix = [[None] * STATES for _ in range(STATES)]
    for p in range(STATES):
        own[p][p] = (DELETE_COST, DELETE)
        if symbol != "x":
            more = TRUNCATED_COST if symbol.isupper() else 0
            for role in "sua":
                q = NEXT.get((p, role))
                if q is not None and role == symbol.lower():
                    own[p][q] = cheaper(own[p][q], (more, KEEP))
                if q is not None and role != "s":
                    own[p][q] = cheaper(own[p][q], (more + REROLE_COST, REROLE))
    return product(closed, own)


def finish(row: list[Entry]) -> Entry:
    """Insertions at the end, up to an accepting state."""
    best: Entry = None
    for (p, q), n in INSERTS.items():
        if q in ACCEPTED and row[p] is not None:
            best = cheaper(best, (row[p][0] + n * INSERT_COST, joined(row[p][1], INSERT * n)))
    return best


class Grammar:
    """Re-Pair rules and the transfer matrix of every symbol and rule."""

    def __init__(self):
        self.rules: dict[tuple[int, int], int] = {}
        self.matrices = [symbol_matrix(s) for s in SYMBOLS]

    def rule(self, pair: tuple[int, int]) -> int:
        if pair not in self.rules:
            self.rules[pair] = len(self.matrices)
            self.matrices.append(product(self.matrices[pair[0]], self.matrices[pair[1]]))
        return self.rules[pair]

    def compress(self, words: Iterable[str]) -> list[list[int]]:
        """The words as symbols and rules: the commonest pair becomes a rule until no pair is there twice."""
        seq: list[int] = []
        last: list[int] = []
        nxt: list[int] = []
        heads = []
        for word in words:
            heads.append(len(seq))
            at = range(len(seq), len(seq) + len(word))
            seq += map(SYMBOLS.index, word)
            last += [i - 1 for i in at]
            nxt += [i + 1 for i in at]
            if word:
                last[at[0]] = nxt[at[-1]] = -1
            else:
                heads[-1] = -1
        places: defaultdict[tuple[int, int], set[int]] = defaultdict(set)
        for i, j in enumerate(nxt):
            if j >= 0:
                places[seq[i], seq[j]].add(i)
        queue = [(-len(v), pair) for pair, v in places.items()]
        heapq.heapify(queue)
        while queue:
            count, pair = heapq.heappop(queue)
            found = places.get(pair, ())
            if len(found) < 2:
                continue
            if -count != len(found):
                heapq.heappush(queue, (-len(found), pair))
                continue
            new, touched = self.rule(pair), set()
            for i in sorted(places.pop(pair)):
                j = nxt[i]
                if seq[i] != pair[0] or j < 0 or seq[j] != pair[1]:
                    continue  # one before it, which overlaps, has been replaced
                p, q = last[i], nxt[j]
                for k, gone in ((p, (seq[p], seq[i])), (j, (seq[j], seq[q]))):
                    if gone in places:
                        places[gone].discard(k)
                seq[i], seq[j], nxt[i] = new, -1, q
                if q >= 0:
                    last[q] = i
                    places[new, seq[q]].add(i)
                    touched.add((new, seq[q]))
                if p >= 0:
                    places[seq[p], new].add(p)
                    touched.add((seq[p], new))
            for other in touched:
                heapq.heappush(queue, (-len(places[other]), other))
        packed = []
        for i in heads:
            packed.append([])
            while i >= 0:
                packed[-1].append(seq[i])
                i = nxt[i]
        return packed


# pieces in order

PIECES = "conv_id long, turn long, role string, digest string, whole boolean, illegal long, head string, tail string, cost long, audit string, costs array<long>, audits array<string>"


class _Piece:
    def __init__(self, conv_id, key, first: bool):
        self.conv_id, self.key, self.first, self.last = conv_id, key, first, False
        self.symbols: list[str] = []
        self.illegal, self.head, self.tail = 0, "", ""

    def add(self, initial: str, symbol: str) -> None:
        if not self.symbols:
            self.head = initial
        elif self.tail + initial not in LEGAL:
            self.illegal += 1
        self.tail = initial
        self.symbols.append(symbol)


def _solved(pieces: list[_Piece], grammar: Grammar) -> pa.RecordBatch:
    """Costs and audits of pieces: of the whole conversation, or from every state to every state."""
    words = list(dict.fromkeys("".join(p.symbols) for p in pieces))
    packed = dict(zip(words, grammar.compress(words)))
    known: dict = {}
    rows = []
    for piece in pieces:
        word, whole = "".join(piece.symbols), piece.first and piece.last
        if (word, whole) not in known:
            paths = []
            for p in range(1 if whole else STATES):
                row = unit(p)
                for s in packed[word]:
                    row = times(row, grammar.matrices[s])
                paths.append(row)
            if whole:
                cost, rope = finish(paths[0])
                known[word, whole] = (cost, text_of(rope), None, None)
            else:
                flat = [e for row in paths for e in row]
                known[word, whole] = (None, None, [e and e[0] for e in flat], [e and text_of(e[1]) for e in flat])
        rows.append((piece.conv_id, *piece.key, whole, piece.illegal, piece.head, piece.tail, *known[word, whole]))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string())]
    columns = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in PIECES.split(", ")])


def pieces(marked: DataFrame) -> DataFrame:
    """Solved pieces of the rows of `faults`; ``whole`` ones are conversations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar, now, ready, opened = Grammar(), None, [], False
        for batch in batches:
            for conv_id, turn, role, digest, blank, seen, truncated, n in zip(*(c.to_pylist() for c in batch.columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        now.last = True
                        ready.append(now)
                    # the first conversation of a task may have begun in the one before
                    now, opened = _Piece(conv_id, (turn, role, digest), opened), True
                initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
                sound = initial.upper() if truncated else initial
                for copy in range(n):
                    if len(now.symbols) >= PIECE:
                        ready.append(now)
                        if len(ready) >= PIECE:
                            yield _solved(ready, grammar)
                            ready = []
                        now = _Piece(conv_id, (turn, role, f"{digest}:{copy:019d}"), False)
                    now.add(initial, "x" if blank or seen or copy else sound)
            if ready:
                if len(grammar.rules) > RULES:
                    grammar = Grammar()
                yield _solved(ready, grammar)
                ready = []
        if now is not None:
            yield _solved([now], grammar)

    order = ["conv_id", "turn", "role", "digest"]
    rows = marked.select(*order, "blank", "seen", "truncated", "n").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, PIECES)


EDITS = "conv_id long, cost long, audit string, illegal long"


def edits(marked: DataFrame) -> DataFrame:
    """conv_id, cost, audit and illegal (neighbours whose roles may not meet) of every conversation with rows."""

    def combine(table: pa.Table) -> pa.Table:
        parts = sorted(table.to_pylist(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["digest"]))
        row, illegal, tail = unit(0), 0, None
        for part in parts:
            entries = [None if c is None else (c, a) for c, a in zip(part["costs"], part["audits"])]
            row = times(row, [entries[i : i + STATES] for i in range(0, STATES * STATES, STATES)])
            illegal += part["illegal"] + (tail is not None and tail + part["head"] not in LEGAL)
            tail = part["tail"]
        cost, rope = finish(row)
        return pa.table({"conv_id": pa.array([parts[0]["conv_id"]], pa.int64()), "cost": [cost], "audit": [text_of(rope)], "illegal": pa.array([illegal], pa.int64())})

    solved = stored(pieces(marked), "repair-pieces")
    whole = solved.where("whole").select("conv_id", "cost", "audit", "illegal")
    return whole.unionByName(solved.where("not whole").groupBy("conv_id").applyInArrow(combine, EDITS))


# repaired rows

REPAIRED = "conv_id long, place long, edit string, role string, text string"


def repaired(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit, role, text.

    Each conversation's rows stand together in one partition and in order; its audit comes first and is
    followed row by row, so a task holds one batch at a time, however long a conversation is.
    """
    texts = _filled(rows).select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    told = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        conv_id = letters = None
        at = place = state = 0

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            out.append((conv_id, place, edit, role, text))
            place, state = place + 1, NEXT[state, role[0]]

        def insert() -> None:
            nonlocal at
            while at < len(letters) and letters[at] == INSERT:
                put(INSERT, DUE[state], "")
                at += 1

        def taken() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [c.split()[0] for c in REPAIRED.split(", ")])

        for batch in batches:
            for conv, kind, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "kind", "role", "text"))):
                if kind == 0:
                    if letters is not None:
                        insert()
                    conv_id, letters, at, place, state = conv, text, 0, 0, 0
                    continue
                insert()
                edit = letters[at]
                at += 1
                if edit != DELETE:
                    put(edit, role if edit == KEEP else DUE[state], text)
            yield taken()
        if letters is not None:
            insert()
            yield taken()

    met = texts.unionByName(told).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return met.select("conv_id", "kind", "role", "text").mapInArrow(run, REPAIRED)


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and the digest of ``role:text``, joined by newlines, of `repaired` rows as they come (not shuffled in between)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, running = None, None
        for batch in batches:
            done = []
            for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text"))):
                if place == 0:
                    if running is not None:
                        done.append((now, running.hexdigest()))
                    now, running = conv, hashlib.sha256()
                else:
                    running.update(b"\n")
                running.update(f"{role}:{text}".encode())
            if done:
                yield _digested(done)
        if running is not None:
            yield _digested([(now, running.hexdigest())])

    return rows.mapInArrow(run, "conv_id long, repaired_sha256 string")


def _digested(done: list[tuple]) -> pa.RecordBatch:
    ids, hashes = zip(*done)
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])


def report(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """One row per conversation of the original table, about its rows as they are now.

    conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256; without rows: zeros,
    an empty audit and the digest of nothing.
    """
    marked = stored(faults(rows), "repair-rows")
    audits = stored(edits(marked), "repair-edits")
    n = F.col("n")
    kind = F.when(F.col("blank"), "blank").when(F.col("seen"), "seen").when(F.col("truncated"), "truncated").otherwise("sound")
    counted = marked.withColumn("kind", kind).groupBy("conv_id").agg(
        F.sum(F.when(F.col("kind") == "blank", n).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("kind") == "blank", 0).when(F.col("kind") == "seen", n).otherwise(n - 1)).alias("duplicate"),
        F.sum(F.when(F.col("kind") == "truncated", 1).otherwise(0)).alias("truncated"),
    )
    turns = marked.select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    parts = conversations.select("conv_id").distinct()
    for part in (counted, turns, audits, digests(repaired(rows, audits))):
        parts = parts.unionByName(part, allowMissingColumns=True)
    one = parts.groupBy("conv_id").agg(*(F.max(c).alias(c) for c in parts.columns if c != "conv_id"))
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = hashlib.sha256().hexdigest()
    return one.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))
