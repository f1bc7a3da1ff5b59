"""The operators applied to their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from introna.llm import bpe, chat, html, infilling, licenses, minhash, mixing, neighbours, quality, repair, surrogates, token_counts, toxicity
from introna.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SIZE_SQL = r"coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)"


def query(name: str, sql: str | None = None):
    def register(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


CHAT_SQL = """
WITH turns AS (
    SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i,
        '<|im_start|>' || replace(replace(coalesce(role, 'unknown'), '<|', '< |'), chr(10), ' ') || chr(10) || replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS line,
        CASE WHEN role = 'assistant' THEN length(replace(coalesce(text, ''), '<|', '< |')) + 11 ELSE 0 END AS trained
    FROM conversations WHERE conv_id IS NOT NULL),
sides AS (SELECT pair_id, max(i) FILTER (WHERE side = 0) AS n, max(i) FILTER (WHERE side = 1) AS m FROM turns GROUP BY pair_id),
met AS (
    SELECT a.pair_id, min(a.i) AS first FROM turns a JOIN turns b ON a.pair_id = b.pair_id AND a.i = b.i AND a.side = 0 AND b.side = 1
    WHERE a.line <> b.line GROUP BY a.pair_id),
common AS (
    SELECT s.pair_id, coalesce(m.first - 1, least(s.n, s.m)) AS n_common
    FROM sides s LEFT JOIN met m USING (pair_id) WHERE s.n IS NOT NULL AND s.m IS NOT NULL),
rest AS (
    SELECT t.*, n_common, sum(length(line)) OVER (PARTITION BY pair_id, side ORDER BY i) AS stop
    FROM turns t JOIN common USING (pair_id) WHERE i > n_common),
prompts AS (SELECT pair_id, string_agg(line, '' ORDER BY i) AS prompt FROM turns JOIN common USING (pair_id) WHERE side = 0 AND i <= n_common GROUP BY pair_id),
done AS (
    SELECT pair_id, side, string_agg(line, '' ORDER BY i) AS text,
        string_agg((stop - trained)::BIGINT || ':' || stop::BIGINT, ';' ORDER BY i) FILTER (WHERE trained > 0) AS mask
    FROM rest GROUP BY pair_id, side)
SELECT c.pair_id, c.n_common::INTEGER AS n_common, coalesce(prompt, '') AS prompt, coalesce(a.text, '') AS chosen, coalesce(b.text, '') AS rejected,
    coalesce(a.mask, '') AS chosen_mask, coalesce(b.mask, '') AS rejected_mask, a.mask IS NOT NULL AND b.mask IS NOT NULL AS usable
FROM common c LEFT JOIN prompts USING (pair_id)
LEFT JOIN done a ON a.pair_id = c.pair_id AND a.side = 0 LEFT JOIN done b ON b.pair_id = c.pair_id AND b.side = 1
"""


@query("op1_chat", CHAT_SQL)
def op1_chat(spark, folder):
    """Every two neighbouring conversations as a preference pair."""
    turns = table(spark, folder, "conversations")
    return chat.preferences(turns, chat.neighbours_by_id(turns))


@query("op2_html")
def op2_html(spark, folder):
    """Visible text of all pages."""
    return html.extract(table(spark, folder, "pages")).select("page_id", "url", "text")


@query("op5_surrogates")
def op5_surrogates(spark, folder):
    """All documents with surrogates for personal data."""
    return surrogates.replace(table(spark, folder, "documents")).select("doc_id", "text", "n_entities")


@query("op3_bpe")
def op3_bpe(spark, folder):
    """Every document encoded and decoded again, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    done = bpe.decode(bpe.encode(docs, tokenizer_path(), keep_text=False), tokenizer_path())
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op4_token_counts")
def op4_token_counts(spark, folder):
    """Totals, quantiles and truncated totals for every context limit."""
    return token_counts.token_limits(table(spark, folder, "documents"), tokenizer_path())


MIX_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, {SIZE_SQL}::BIGINT AS size,
        ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
    FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
    SELECT *, [3.0::DOUBLE, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight, source_size * 2.0::DOUBLE AS clamp
    FROM sources),
levels AS (
    SELECT *, clamp / weight AS per_weight,
        (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(clamp) OVER (
            ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY clamp / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
    FROM weighed),
water AS (SELECT max(level) AS level FROM levels WHERE level <= per_weight),
goals AS (
    SELECT source, source_size, CASE WHEN w.level < per_weight THEN w.level * weight ELSE clamp END AS target
    FROM levels CROSS JOIN water w),
wholes AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM goals),
running AS (
    SELECT s.doc_id, s.size, g.source_size, g.target, g.whole, g.target - g.whole * g.source_size AS extra,
        sum(s.size) OVER (PARTITION BY s.source ORDER BY s.place, s.doc_id, s.size ROWS UNBOUNDED PRECEDING) AS words
    FROM sized s JOIN wholes g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
    (size * (whole + CASE WHEN 2 * words - size <= 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running
"""


@query("op6_mixing", MIX_SQL)
def op6_mixing(spark, folder):
    """What the mix takes of every document."""
    return mixing.mix_plan(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@query("op7_toxicity")
def op7_toxicity(spark, folder):
    """Toxicity of all documents."""
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op8_minhash")
def op8_minhash(spark, folder):
    """Near-duplicate classes of all documents."""
    return minhash.classes(table(spark, folder, "documents"), width=2, percent=80).drop("set_key")


NEAREST_SQL = """
WITH sound AS (
    SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
    WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v) AS score
    FROM sound q JOIN sound c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query("op9_neighbours", NEAREST_SQL)
def op9_neighbours(spark, folder):
    """The 20 nearest vectors of every 20th."""
    return neighbours.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def _quality_sql() -> str:
    names = list(quality.RULES)
    votes = ", ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END AS vote_{n}" for n, (bad, good) in quality.RULES.items())
    columns = ", ".join(f"vote_{n}" for n in names)
    odds = "ln(m.prior / (1 - m.prior)) + " + " + ".join(
        f"CASE vote_{n} WHEN 1 THEN ln(m.good_{n} / (1 - m.bad_{n})) WHEN -1 THEN ln((1 - m.good_{n}) / m.bad_{n}) ELSE 0 END" for n in names
    )
    start = ", ".join(f"{quality.START_ON_GOOD}::DOUBLE AS good_{n}, {quality.START_ON_BAD}::DOUBLE AS bad_{n}" for n in names)
    steps = [f"m0 AS (SELECT {quality.START_PRIOR}::DOUBLE AS prior, {start})"]
    for i in range(quality.ROUNDS):
        right = ", ".join(
            f"round((coalesce(sum(docs * {mass}) FILTER (WHERE vote_{n} = {hit}), 0) + 1)"
            f" / (coalesce(sum(docs * {mass}) FILTER (WHERE vote_{n} <> 0), 0) + 2), 9) AS {kind}_{n}"
            for n in names for kind, mass, hit in (("good", "good", 1), ("bad", "(1 - good)", -1))
        )
        steps.append(f"e{i} AS MATERIALIZED (SELECT p.*, 1 / (1 + exp(-({odds}))) AS good FROM patterns p, m{i} m)")
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT round((sum(docs * good) + 1) / (sum(docs) + 2), 9) AS prior, {right} FROM e{i})")
    return rf"""
WITH texts AS (SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT n, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM texts),
places AS (SELECT n, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
    FROM (SELECT n, words, unnest(range(1, len(words) - 1)) AS i FROM words)),
counted AS (SELECT n, i, count(*) OVER (PARTITION BY n, a, b, c) AS times FROM places),
covered AS (SELECT n, count(DISTINCT i + d) AS n_repeat_words FROM counted, range(3) t(d) WHERE times > 1 GROUP BY n),
measured AS (
    SELECT w.doc_id, len(words)::BIGINT AS n_words, len(lines) AS n_lines,
        length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        length(regexp_replace(text, '[^|]+', '', 'g')) AS n_bars, length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks,
        length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS n_upper, length(regexp_replace(text, '[^\pL]+', '', 'g')) AS n_letters,
        len(regexp_extract_all(text, '[\p{{P}}\p{{S}}]{{2,}}')) AS n_runs,
        (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(list_distinct(words)) AS n_distinct_words,
        coalesce(c.n_repeat_words, 0)::BIGINT AS n_repeat_words
    FROM words w LEFT JOIN covered c USING (n)),
voted AS (
    SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed, {votes}
    FROM measured),
patterns AS (SELECT {columns}, count(*)::BIGINT AS docs FROM voted WHERE NOT base_failed GROUP BY ALL),
{", ".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    NOT base_failed AND 1 / (1 + exp(-({odds}))) >= 0.5 AS kept
FROM voted CROSS JOIN m{quality.ROUNDS} m
"""


@query("op10_quality", _quality_sql())
def op10_quality(spark, folder):
    """Verdict of the quality rules on every document."""
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


INFILLING_SQL = r"""
WITH cut AS (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units,
        sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents),
drawn AS (
    SELECT doc_id, text, units, len(units)::BIGINT AS n,
        ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS two,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
            OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 100 THEN 'plain'
            WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
    FROM cut),
parts AS (
    SELECT *, array_to_string(units[1:least(one, two)], '') AS prefix, array_to_string(units[least(one, two) + 1:greatest(one, two)], '') AS middle,
        array_to_string(units[greatest(one, two) + 1:], '') AS suffix
    FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
    sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
    sha256(text) AS restored_sha256
FROM parts
"""


@query("op12_infilling", INFILLING_SQL)
def op12_infilling(spark, folder):
    """Every document rearranged for filling in the middle, and rebuilt, as digests."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    made = infilling.restore(infilling.transform(docs))
    digest = {f"{c}_sha256": F.sha2(F.col(c).cast("binary"), 256) for c in ("output", "restored")}
    return made.withColumns(digest).select("doc_id", F.col("n_units").alias("n"), "form", "prefix_chars", "middle_chars", *digest)


def _license_sql() -> str:
    wordings = [(label, " ".join(licenses.plain_words(text)), exact)
                for exact, told in (("false", licenses.TEMPLATES), ("true", licenses.PHRASES)) for label, text in told]
    values = ",\n        ".join(f"({n}, '{label}', '{text}', {exact})" for n, (label, text, exact) in enumerate(wordings))
    return rf"""
WITH texts AS (
    SELECT row_number() OVER () AS r, doc_id,
        regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM documents),
templates AS (
    SELECT *, len(w) AS length, (len(w) + 9) // 10 AS slack FROM (
        SELECT template, label, string_split(wording, ' ') AS w, exact FROM (VALUES
        {values}) t(template, label, wording, exact))),
grams AS (SELECT r, unnest(range(len(w))) AS i, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM texts),
known AS (
    SELECT template, label, exact, length, slack, unnest(range(len(w))) AS spot, unnest(w) AS a, unnest(w[2:]) AS b, unnest(w[3:]) AS c FROM templates),
hits AS (SELECT r, template, label, exact, length, slack, i - spot AS diagonal, spot FROM grams JOIN known USING (a, b, c)),
votes AS (
    SELECT *, count(*) OVER (PARTITION BY r, template, diagonal) AS n FROM hits),
phrases AS (
    SELECT r, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS base
    FROM (SELECT DISTINCT r, template, label, diagonal FROM votes WHERE exact AND n = length - 2) GROUP BY r),
strong AS (SELECT DISTINCT r, template, length, slack, diagonal FROM votes WHERE NOT exact AND 100 * n >= {licenses.FEW_PERCENT} * (length - 2)),
steps AS (
    SELECT *, coalesce((diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal) > slack)::INTEGER, 1) AS apart FROM strong),
islands AS (SELECT *, sum(apart) OVER (PARTITION BY r, template ORDER BY diagonal) AS island FROM steps),
words AS (
    SELECT DISTINCT i.r, i.template, v.label, i.length, i.slack, island, i.diagonal, v.spot + d AS word
    FROM islands i JOIN votes v ON i.r = v.r AND i.template = v.template AND i.diagonal = v.diagonal CROSS JOIN range(3) t(d)),
alone AS (SELECT *, count(*) OVER (PARTITION BY r, template, diagonal) AS alone FROM words),
merged AS (
    SELECT r, template, label, length, slack, island, count(DISTINCT word) AS together, max(alone) AS alone,
        min(diagonal + word) AS start, max(diagonal + word) + 1 AS stop
    FROM alone GROUP BY ALL),
spans AS (
    SELECT *, CASE WHEN 2 * (stop - start) <= 3 * length + 2 * slack THEN together ELSE alone END AS matched FROM merged),
sure AS (
    SELECT * FROM spans
    WHERE CASE WHEN length < {licenses.SHORT} THEN matched = length ELSE 100 * matched >= {licenses.COVER_PERCENT} * length END),
reached AS (
    SELECT *, coalesce((start >= max(stop) OVER (
        PARTITION BY r ORDER BY start, stop, template ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INTEGER, 1) AS fresh
    FROM sure),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY r ORDER BY start, stop, template ROWS UNBOUNDED PRECEDING) AS part FROM reached),
ranked AS (SELECT *, rank() OVER (PARTITION BY r, part ORDER BY matched DESC, length) AS place FROM grouped),
more AS (SELECT r, list(DISTINCT label) AS more FROM ranked WHERE place = 1 GROUP BY r),
shares AS (SELECT r, max(matched / length) AS share FROM spans GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
    coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
    coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
    CASE WHEN base IS NOT NULL THEN 1.0::DOUBLE ELSE coalesce(share, 0) END AS score
FROM texts LEFT JOIN phrases USING (r) LEFT JOIN more USING (r) LEFT JOIN shares USING (r)
"""


@query("op13_licenses", _license_sql())
def op13_licenses(spark, folder):
    """Licenses named or quoted in every document."""
    return licenses.scan(table(spark, folder, "documents"))


def _repair_sql() -> str:
    moves = ", ".join(f"({p}, {q}, {n})" for (p, q), n in repair.INSERTS.items())
    legal = ", ".join(f"({p}, '{role}', {q})" for (p, role), q in repair.NEXT.items())
    due = " ".join(f"WHEN {p} THEN '{role}'" for p, role in repair.DUE.items())
    return rf"""
WITH RECURSIVE filled AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
    FROM conversations),
hashed AS (
    SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)),
        lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
            lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind
    FROM filled),
damaged AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, row_number() OVER () AS rid
    FROM hashed, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), rid) AS i,
        row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, rid) AS time, substr(role, 1, 1) AS initial
    FROM damaged),
marked AS (
    SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN time > 1 THEN 'duplicate'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous
    FROM placed),
sums AS (
    SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank,
        count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
        count(*) FILTER (WHERE i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n
    FROM marked GROUP BY conv_id),
moves AS (SELECT p, q, n, {repair.INSERT_COST} * n AS cost, repeat('{repair.INSERT}', n) AS letters,
        CASE n WHEN 0 THEN '' WHEN 1 THEN CASE p {due} END || ':' || chr(10) ELSE 'user:' || chr(10) || 'assistant:' || chr(10) END AS made
    FROM (VALUES {moves}) t(p, q, n)),
legal AS (SELECT * FROM (VALUES {legal}) t(p, role, q)),
options AS (
    SELECT conv_id, i, p, p AS q, {repair.DELETE_COST} AS cost, '{repair.DELETE}' AS letter, '' AS made FROM marked, range({repair.STATES}) t(p)
    UNION ALL
    SELECT conv_id, i, p, q, CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED_COST} ELSE 0 END, '{repair.KEEP}', m.role || ':' || text || chr(10)
    FROM marked m JOIN legal l ON l.role = m.initial WHERE fault NOT IN ('blank', 'duplicate')
    UNION ALL
    SELECT conv_id, i, p, q, {repair.REROLE_COST} + CASE WHEN fault = 'truncated' THEN {repair.TRUNCATED_COST} ELSE 0 END, '{repair.REROLE}',
        CASE p {due} END || ':' || text || chr(10)
    FROM marked m, legal l WHERE l.role <> 's' AND fault NOT IN ('blank', 'duplicate')),
walk AS (
    SELECT conv_id, 0::BIGINT AS i, 0 AS state, {{'cost': 0::BIGINT, 'audit': '', 'made': ''}} AS best FROM sums
    UNION ALL
    SELECT w.conv_id, w.i + 1, o.q, min({{'cost': (w.best.cost + v.cost + o.cost)::BIGINT, 'audit': w.best.audit || v.letters || o.letter, 'made': w.best.made || v.made || o.made}})
    FROM walk w JOIN moves v ON v.p = w.state JOIN options o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1 AND o.p = v.q
    GROUP BY w.conv_id, w.i, o.q),
ends AS (
    SELECT s.conv_id, min({{'cost': (best.cost + v.cost)::BIGINT, 'audit': best.audit || letters, 'made': best.made || v.made}}) AS best
    FROM sums s JOIN walk w ON w.conv_id IS NOT DISTINCT FROM s.conv_id AND w.i = s.n JOIN moves v ON v.p = w.state AND v.q IN (0, 3) GROUP BY s.conv_id)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
    coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.cost, 0)::BIGINT AS cost,
    coalesce(best.audit, '') AS audit, sha256(coalesce(substr(best.made, 1, length(best.made) - 1), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM c.conv_id
"""


@query("op11_repair", _repair_sql())
def op11_repair(spark, folder):
    """Every conversation damaged and repaired at least cost."""
    conversations = table(spark, folder, "conversations")
    return repair.report(conversations, repair.damage(conversations))
