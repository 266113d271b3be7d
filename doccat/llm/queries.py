"""The registered queries of the operators, each next to its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doccat.llm import decontam, jaccard, langid, merkle, packing, pii, quality, runs, simhash, suffix, tokens, toolcalls, warc
from doccat.llm.common import new_folder
from doccat.operators.scale import ship_code

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; a default for the operators' path parameters."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op2_token_shards")
def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = tokens.write_tokens(
        table(spark, sf_dir, "documents"), new_folder(spark), vocabulary("byte_bpe_50k.json"),
        end_id=2,
    )
    return tokens.read_tokens(manifest, ids=False)


@query(
    "op9_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
    d AS (SELECT page_id, strlen(html) AS payload_bytes, sha256(html) AS payload_digest FROM p),
    f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
      true AS intact FROM f""",
)
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_warc(table(spark, sf_dir, "pages"), new_folder(spark))
    return warc.read_warc(manifest, payload=False).drop("url")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.token_pieces(
        table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=1
    )
    return packing.pack(pieces)


@query("op3_simhash")
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def quality_sql() -> str:
    """Counts, references and verdicts of ``quality.judge`` in DuckDB."""
    names = quality.word_bins()
    classes = list(quality.CLASSES.values())

    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    counts = ", ".join(
        f"length(regexp_replace(t, {quoted(f'[^{c}]+')}, '', 'g'))" for c in classes
    )
    listed = "[" + ", ".join(map(quoted, names)) + "]"
    share = "list_transform({0}, lambda x: CASE WHEN list_sum({0}) > 0 THEN x / list_sum({0}) ELSE 0.0 END)"
    n_classes, n_bins = len(classes) + 1, len(names) + 1
    mean = "[" + ", ".join("avg({0}[%d])" % (i + 1) for i in range(n_bins)) + "]"
    mean_c = "[" + ", ".join("avg(c[%d])" % (i + 1) for i in range(n_classes)) + "]"
    term = "CASE WHEN {0} > 0 THEN {0} * log2(2 * {0} / ({0} + {1})) ELSE 0.0 END"

    def distance(p: str, q: str) -> str:
        x, y = f"{p}[i]", f"{q}[i]"
        return (
            f"sqrt(greatest(list_sum(list_transform(range(1, len({p}) + 1), "
            f"lambda i: {term.format(x, y)} + {term.format(y, x)})) / 2, 0.0))"
        )

    hits = [
        f"{{'n': -len(list_filter(common, lambda x: list_contains([{', '.join(map(quoted, words))}], x))), 'lang': '{lang}'}}"
        for lang, words in sorted(quality.COMMON_WORDS.items())
    ]
    guess = f"list_min([{', '.join(hits)}]).lang"

    return f"""WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
    s AS (SELECT doc_id, lang, t,
      list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
    win AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM s WHERE len(w) >= 5)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
    cover AS (SELECT doc_id, sum(least(5, i - before)) AS n FROM
      (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -10) AS before FROM twice) GROUP BY doc_id),
    f AS (SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
      length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
      len(l) - len(list_distinct(l)) AS n_dup_lines, length(t) AS chars, [{counts}] AS cc,
      list_filter(list_transform(w, lambda x: lower(x)), lambda x: list_contains({listed}, x)) AS common FROM s),
    b AS (SELECT f.*, coalesce(cover.n, 0) AS n_repeat_words, list_append(cc, chars - list_sum(cc)) AS classes,
      list_append(list_transform({listed}, lambda c: len(list_filter(common, lambda x: x = c))), n_words - len(common)) AS bins
      FROM f LEFT JOIN cover USING (doc_id)),
    h AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
      chars >= {quality.LEAST_CHARS} AND n_words >= {quality.LEAST_WORDS} AS long_enough,
      {share.format('classes')} AS c, {share.format('bins')} AS p FROM b),
    r AS (SELECT lang, {mean_c} AS rc, {mean.format('p')} AS rp FROM h
      WHERE long_enough AND NOT base_failed AND lang IS NOT NULL GROUP BY lang),
    g AS (SELECT h.*, CASE WHEN lang IN (SELECT lang FROM r) THEN lang WHEN len(common) > 0 THEN {guess} END AS ref FROM h),
    own AS (SELECT g.*, {distance('c', 'rc')} + {distance('p', 'rp')} AS far FROM g LEFT JOIN r ON r.lang = g.ref)
    SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
      CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
      CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
      NOT base_failed AND (NOT long_enough OR coalesce(far <= {quality.MOST_DISTANCE} + {quality.CHANCE} / sqrt(n_words), true)) AS kept
    FROM own"""


@query("op1_divergence", quality_sql())
def op1_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("class_distance", "word_distance")


@query("op6_disclosure")
def op6_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query("op7_byte_cnn")
def op7_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = langid.held_out(F.col("doc_id"))
    model = langid.train(docs, F.col("doc_id").isNotNull() & ~held)
    return langid.predict(docs, model).select("doc_id", held.alias("held_out"), "lang_pred", "score")


@query("op5_decontaminate")
def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def toolcalls_sql() -> str:
    """``toolcalls.turns_as_calls`` and ``link_calls`` in DuckDB."""
    words = "list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '')"
    return f"""WITH t AS (SELECT conv_id, turn, role, text, string_split(text, chr(10)) AS lines, len({words}) AS n
      FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
    u AS (SELECT *, len(lines) > 1 OR n >= 30 AS many FROM t WHERE role = 'user'),
    c AS (SELECT conv_id, concat(conv_id, ':', turn) AS call_id, turn,
      CASE WHEN many THEN 'summarise' ELSE 'answer' END AS name,
      CASE WHEN many THEN CAST(to_json({{'lines': lines, 'n_words': n, 'text': text}}) AS VARCHAR)
        ELSE CAST(to_json({{'line': lines[1], 'n_words': n, 'text': text}}) AS VARCHAR) END AS arguments FROM u),
    one AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, call_id ORDER BY turn, name, arguments) = 1),
    r AS (SELECT conv_id, concat(conv_id, ':', turn - 1) AS call_id, count(*) AS n_results, min(text) AS content
      FROM t WHERE role <> 'user' OR role IS NULL GROUP BY ALL)
    SELECT conv_id, call_id, turn, CASE WHEN name IS NOT NULL THEN 0 END AS stage, name,
      CASE WHEN name IS NULL THEN 'orphan' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status,
      CASE WHEN name IS NOT NULL THEN '' END AS problems, coalesce(n_results, 0) AS n_results, content,
      CASE WHEN name IS NOT NULL THEN concat('{{"arguments":', arguments, ',"id":', CAST(to_json(call_id) AS VARCHAR), ',"name":',
        CAST(to_json(name) AS VARCHAR), ',"result":', coalesce(CAST(to_json(content) AS VARCHAR), 'null'), '}}') END AS canonical
    FROM one FULL JOIN r USING (conv_id, call_id)"""


@query("op4_toolcalls", toolcalls_sql())
def op4_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.turns_as_calls(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link_calls(calls, results, toolcalls.TURN_TOOLS)
    return linked.withColumn("problems", F.array_join("problems", ","))


@query("op8_suffix")
def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeats(table(spark, sf_dir, "documents"), kept=False)


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text in DuckDB, bit by bit."""
    bit = "xor(c >> 1, 3988292384 * (c & 1))"
    step = f"list_reduce(range(8), lambda c, k: {bit}, xor(c, b))"
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ord(x) AS BIGINT)), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


def merkle_sql(source_levels: int = 6, top_levels: int = 4) -> str:
    """``merkle.manifest`` in DuckDB for up to ``16**levels`` documents a source and sources."""

    def leaf(text: str) -> str:
        values = {**{c: c for c in merkle.FIELDS}, "text": text}
        each = [f"CASE WHEN {c} IS NULL THEN '-' ELSE concat(strlen(CAST({v} AS VARCHAR)), ':', {v}) END" for c, v in values.items()]
        return f"sha256(concat({', '.join(each)}))"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

    def level(name: str, k: int) -> str:
        run = "PARTITION BY tree, pos // 16 ORDER BY pos ROWS BETWEEN"
        return f"""{name}s{k} AS (SELECT tree, pos, n, h,
          coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
          coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k}),
        {name}{k + 1} AS (SELECT tree, pos // 16 AS pos, (n + 15) // 16 AS n,
          CASE WHEN n > 1 THEN sha256(string_agg(h, '' ORDER BY pos)) ELSE any_value(h) END AS h FROM {name}{k} GROUP BY tree, pos // 16, n)"""

    def climb(name: str, k: int, tree: str, pos: str, before: str) -> str:
        return f"""{name}f{k} AS (SELECT d.* EXCLUDE (proof, f), d.proof || x.l || x.r AS proof,
          CASE WHEN x.n > 1 THEN sha256(x.l || d.f || x.r) ELSE d.f END AS f
          FROM {before} d JOIN {name}s{k} x ON x.tree = d.{tree} AND x.pos = d.{pos} // {16 ** k})"""

    parts = [
        f"""d AS (SELECT doc_id, source, {leaf('text')} AS leaf,
          CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS other FROM documents)""",
        "src AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM documents))",
        """p AS (SELECT doc_id, leaf, other, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
          count(*) OVER (PARTITION BY tree) AS n FROM d JOIN src ON d.source IS NOT DISTINCT FROM src.source)""",
        "a0 AS (SELECT tree, pos, n, leaf AS h FROM p)",
        *[level("a", k) for k in range(source_levels)],
        f"z0 AS (SELECT 0 AS tree, tree AS pos, count(*) OVER () AS n, h FROM a{source_levels})",
        *[level("z", k) for k in range(top_levels)],
        "c AS (SELECT doc_id, leaf, tree, 0 AS zero, pos, coalesce(other, leaf) AS f, '' AS proof FROM p)",
    ]
    before = "c"
    for k in range(source_levels):
        parts.append(climb("a", k, "tree", "pos", before))
        before = f"af{k}"
    for k in range(top_levels):
        parts.append(climb("z", k, "zero", "tree", before))
        before = f"zf{k}"
    ctes = ",\n".join(parts)
    return f"""WITH {ctes}
    SELECT c.doc_id, c.leaf, u.h AS subroot, t.h AS root, sha256(c.proof) AS proof_sha256, c.f AS folded_root, c.f = t.h AS verified
    FROM {before} c JOIN a{source_levels} u ON u.tree = c.tree CROSS JOIN z{top_levels} t"""


@query("op12_merkle", merkle_sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A translate of A-Z: other letters stay as they are.
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    found = merkle.manifest(table(spark, sf_dir, "documents"), tampered, {"text": lower})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof().alias("proof_sha256"), "folded_root", "verified")


@query("op11_runs")
def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", runs.SPACE), lambda w: w != "")
    looped = F.when((h % 10 == 0) & (F.size(words) > 0), F.array_join(runs.loop_tail(words, h), " ")).otherwise(F.col("text"))
    found = runs.find_runs(table(spark, sf_dir, "documents").select("doc_id", looped.alias("text")))
    best = runs.longest()
    names = ("start", "length", "period")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in names]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.s").alias("start"), (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"), F.floor(-1000 * F.col("best.l") / F.col("best.p")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op13_jaccard")
def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_groups(table(spark, sf_dir, "documents"), words=3, percent=90)
