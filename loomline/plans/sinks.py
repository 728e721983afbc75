"""Queries of sinks, bare token files, sidecars, formatted questions, and readers of whole corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.formats import clip
from ..operators import analytics as A
from ..operators import blocks as B
from ..operators import corpus as C
from ..functions.draws import sql_uniform
from ..operators import evaluation as E
from ..operators import packed as N
from ..operators import prompts as P
from ..operators import tokens as K
from ..session import table
from ..sources import readers as R
from ..sources import sinks as S
from ..sources import tokenfiles as T
from ..sources import tokensource as W
from ..sources.workspace import new_folder
from ..streaming import metrics as M
from .files import _C, _code_blocks, _codes, _sum

c = F.col


def line_sink(s, d):
    path = new_folder(s, "lines")
    S.write_lines(table(s, d, "documents").select("text"), "text", path)
    return S.read_lines(s, path).select(F.md5(c("text").cast("binary")).alias("md5")).groupBy("md5").agg(F.count(F.lit(1)).alias("n"))


def metric_log(s, d):
    """Two steps, the second of them written twice: the last write counts, be it the smaller one."""
    folder = new_folder(s, "metrics")
    labels = table(s, d, "labels")
    for step, below in ((1, 1), (2, 2), (2, 1)):
        rows = labels.where(c("quality") < below).groupBy("toxic").agg(F.count(F.lit(1)).cast("string").alias("n"))
        maps = rows.select(F.create_map(F.concat(F.lit("toxic"), c("toxic").cast("string"), F.lit("_ppl")), F.create_map(F.lit("alias"), F.lit("x"), F.lit("n"), "n")).alias("results"))
        S.append_metrics(E.flat_results(maps, "results", ["toxic0_ppl", "toxic1_ppl"]), folder, step)
    return S.read_metrics(s, folder)


def vocab_sidecar(s, d):
    folder = new_folder(s, "corpus")
    S.write_vocabulary(C.vocabulary(table(s, d, "documents"), "text"), folder)
    return s.createDataFrame([(S.vocabulary_size(s, folder), S.vocabulary_size(s, folder + "-none", 50304))], "size bigint, missing bigint")


def split_reuse(s, d):
    """One corpus brings its own val split, the other has train alone and is cut at random."""
    docs, root = table(s, d, "documents").select("doc_id", "lang"), new_folder(s, "splits")
    docs.where("lang <> 'de'").write.parquet(f"{root}/own/train")
    docs.where("lang = 'de'").write.parquet(f"{root}/own/validation")
    docs.write.parquet(f"{root}/none/train")

    def cut(train):
        both = C.exact_split(train, "doc_id", 0.01)
        return {k: both.where(c("split") == k).drop("split") for k in ("train", "val")}

    parts = [v.select(F.lit(corpus).alias("corpus"), F.lit(name).alias("split"), "doc_id") for corpus in ("own", "none") for name, v in S.splits_of(s, f"{root}/{corpus}", cut).items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("corpus", "split").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


def _bare(s, d):
    """The whole corpus as one bare file of tokens, written by as many tasks as hold its blocks."""
    folder = new_folder(s, "bare")
    N.packed_lists(_code_blocks(s, d, 4096), "ids", "data").write.parquet(f"{folder}/blocks")
    W.write_bin(s.read.parquet(f"{folder}/blocks"), f"{folder}/tokens.bin", 4096, 2)
    return f"{folder}/tokens.bin"


def flat_bare(s, d):
    tokens = T.read_bin(s, _bare(s, d), "uint16", 4096)
    return tokens.select(F.floor(c("pos") / 4096).cast("bigint").alias("block"), F.size("ids").cast("bigint").alias("n"), _sum("ids").alias("total"), c("ids")[0].alias("first_token"))


def flat_ends(s, d):
    n, head, tail = T.ends_of(s, _bare(s, d), "uint16")
    text = lambda ids: "".join(map(chr, ids))
    return s.createDataFrame([(n, text(head), text(tail))], "n bigint, head string, tail string")


def indexed_at(s, d):
    folder = new_folder(s, "indexed")
    T.write_indexed(_codes(s, d), "doc_id", "ids", folder)
    return T.read_indexed(s, folder).select("sample", F.size("ids").cast("bigint").alias("n"), _sum("ids").alias("total"))


def _pair(s, d):
    prefix = f"{new_folder(s, 'pair')}/all"
    W.write_pair(_codes(s, d), "doc_id", "ids", prefix)
    return prefix


def indexed_pair(s, d):
    return W.read_samples(s, _pair(s, d)).select("sample", F.size("ids").cast("bigint").alias("n"), _sum("ids").alias("total"))


def indexed_batch(s, d):
    """One batch of 48 samples from the middle of the pair, and one sample alone: their ranges are all that is read."""
    prefix, first = _pair(s, d), table(s, d, "documents").count() // 2
    rows = W.read_samples(s, prefix, first, first + 48, 16).unionByName(W.read_samples(s, prefix, 3, 4))
    return rows.select("sample", F.size("ids").cast("bigint").alias("n"), _sum("ids").alias("total"))


def whole_files(s, d):
    root = new_folder(s, "whole")
    table(s, d, "region").select("r_name").coalesce(1).sortWithinPartitions("r_name").write.text(root)
    return R.whole_text(s, root).select(F.length("value").cast("bigint").alias("n"), F.md5(c("value").cast("binary")).alias("md5"))


def all_subsets(s, d):
    root = new_folder(s, "subsets")
    table(s, d, "documents").select("doc_id", "lang", "n_chars").write.partitionBy("lang").json(root)
    return R.read_subsets(s, root).groupBy("subset").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


SHARD = "conv(substring(md5(cast(doc_id as string)), 1, 4), 16, 10) % 40"


def shard_files(s, d):
    """The whole table in 40 shards, ten to a group; a path's ending says which to read, of those no more than 12 files."""
    root = new_folder(s, "shards")
    name = F.format_string("%03d_%05d.parquet", F.expr(f"cast({SHARD} as int) div 10"), F.expr(f"cast({SHARD} as int) % 10"))
    table(s, d, "documents").select("doc_id", "n_chars", name.alias("file")).write.partitionBy("file").parquet(root)
    names = R.limit_files(R.shard_range("out/corpus-rest", {"-first": (0, 25), "-rest": (25, 40)}, "file={:03d}_{:05d}.parquet"), 12)
    return s.read.parquet(*[f"{root}/{n}" for n in names]).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


FIELDS = {  # the columns of each evaluation set, from those of `customer`
    "gsm8k": {"question": "c_name", "answer": "c_mktsegment"}, "math": {"problem": "c_name", "solution": "c_mktsegment"},
    "mathqa": {"problem": "c_name", "options": "'a ) 1 , b ) 2'", "rationale": "c_mktsegment"}, "asdiv": {"body": "c_mktsegment", "question": "c_name", "answer": "cast(c_nationkey as string)"},
    "mawps": {"input": "c_name", "target": "c_nationkey"}, "mmlu_stem": {"question": "c_name", "choices": "array(c_mktsegment, 'other', c_name)", "answer": "c_custkey % 3"},
    "ocw": {"problem": "c_name", "solution": "c_mktsegment"}, "sat_math": {"question": "c_name", "options": "'A 1 B 2'", "Answer": "c_mktsegment"},
    "svamp": {"Body": "c_mktsegment", "Question": "c_name", "Answer": "cast(c_nationkey as double) + 0.5D"}, "bbh": {"input": "c_name", "target": "c_mktsegment"}, "gpqa": {"Question": "c_name", "Explanation": "c_mktsegment"},
    "arc_c": {"question": "c_name", "choices": "named_struct('text', array(c_mktsegment, c_name), 'label', array('A', 'B'))", "answerKey": "CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE 'B' END"},
    "hellaswag": {"ctx": "c_name", "endings": "array(c_mktsegment, 'other', c_name)", "label": "cast(c_custkey % 3 as string)"},
}


def qa_formats(s, d):
    out = None
    for name, fields in FIELDS.items():
        rows = table(s, d, "customer").select("c_custkey", *[F.expr(e).alias(k) for k, e in fields.items()])
        part = P.formatted(rows, name, ["c_custkey"]).select(F.lit(name).alias("form"), "c_custkey", F.md5(c("prompt").cast("binary")).alias("prompt_md5"), "answer")
        out = part if out is None else out.unionByName(part)
    return out


def stream_windows(s, d):
    """The events as a stream of files, in windows of six hours; the result after all of them."""
    folder = new_folder(s, "stream")
    table(s, d, "events").select("ts", "event_type", "value").repartition(4).write.parquet(f"{folder}/in")
    events = s.readStream.schema("ts timestamp, event_type string, value double").option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    M.run_to_folder(M.windowed_means(events, "ts", "event_type", "value", "6 hours", "3650 days"), f"{folder}/out", f"{folder}/state")
    return s.read.parquet(f"{folder}/out").select(F.date_format("start", "yyyy-MM-dd HH").alias("start"), "event_type", "n", F.round("mean", 6).alias("mean"))


def multiple_choice_train(s, d):
    """Questions of the validation split, their wrong choices drawn from the training split's values."""
    people = C.exact_split(table(s, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 0.2)
    values = people.where("split = 'train'").select("c_mktsegment").distinct()
    return E.multiple_choice(people.where("split = 'val'"), "c_custkey", "c_mktsegment", values, "c_mktsegment").select("c_custkey", F.array_join("choices", "|").alias("choices"), "answer")


def multiple_choice_rows(s, d):
    """Questions about the orders of the validation split; their wrong choices are those of randomly drawn training rows, an
    attribute of more than a thousand values."""
    orders = C.exact_split(table(s, d, "orders").select("o_orderkey", c("o_custkey").cast("string").alias("value")), "o_orderkey", 0.1)
    others = E.distractors(orders.where("split = 'val'"), "o_orderkey", "value", orders.where("split = 'train'"), "value")
    return E.lettered(others, "o_orderkey", "value", "others").select("o_orderkey", F.array_join("choices", "|").alias("choices"), "answer")


def collate_pad(s, d):
    names = table(s, d, "part").select("p_partkey", F.transform(F.filter(F.split("p_name", ""), lambda x: x != ""), lambda x: F.ascii(x)).alias("ids"))
    text = lambda ids, by: F.array_join(F.transform(ids, lambda i: i.cast("string")), by)
    return B.collate(names, "p_partkey", "ids", 16, -1).select("p_partkey", c("batch").cast("bigint").alias("batch"), text("ids", " ").alias("ids"), text("mask", "").alias("mask"))


def preview_report(s, d):
    """The report of the first documents, written to a file and read again."""
    path = new_folder(s, "report")
    head = table(s, d, "documents").orderBy("doc_id").limit(20).select("doc_id", F.concat_ws("\n", F.concat(F.lit("id: "), c("doc_id").cast("string")), F.concat(F.lit("source: "), c("source")), clip(c("text"), 200)).alias("report"))
    S.write_lines(head.orderBy("doc_id"), "report", path)
    return S.read_lines(s, path).select(c("text").alias("report"))


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


QUERIES = {
    "stream_windows": stream_windows,
    "multiple_choice_train": multiple_choice_train,
    "preview_report": preview_report,
    "first_batches": lambda s, d: B.first_batches(table(s, d, "documents").select("doc_id"), "doc_id", 48, 3).select("doc_id", c("batch").cast("bigint").alias("batch"), c("place").cast("bigint").alias("place")),
    "line_sink": line_sink,
    "metric_log": metric_log,
    "vocab_sidecar": vocab_sidecar,
    "split_reuse": split_reuse,
    "flat_bare": flat_bare,
    "flat_ends": flat_ends,
    "indexed_at": indexed_at,
    "indexed_pair": indexed_pair,
    "whole_files": whole_files,
    "all_subsets": all_subsets,
    "shard_files": shard_files,
    "qa_formats": qa_formats,
    "fixed_choice": lambda s, d: P.fixed_choice(table(s, d, "customer"), "c_custkey", "c_mktsegment", ["BUILDING", "AUTOMOBILE", "MACHINERY", "HOUSEHOLD"]).select("c_custkey", F.array_join("choices", "|").alias("choices"), "answer"),
    "corpus_cut_90_10": lambda s, d: C.corpus_cut(table(s, d, "documents").select("doc_id", "text"), "doc_id", "text", 0.9).select("doc_id", c("cut").alias("n_train"), F.md5(F.expr("substring(text, cast(cut as int) + 1)").cast("binary")).alias("val_md5")),
    "collate_pad": collate_pad,
    "indexed_batch": indexed_batch,
    "multiple_choice_rows": multiple_choice_rows,
    "cosine_columns": lambda s, d: A.cosine_columns(table(s, d, "embeddings"), "embedding").select(c("i").cast("bigint").alias("i"), c("j").cast("bigint").alias("j"), F.round("cosine", 6).alias("cosine")),
    "tokenizer_encode": lambda s, d: K.encode_file(table(s, d, "documents"), "doc_id", "text", _path(), 0).select("doc_id", c("len").cast("bigint").alias("n_tokens"), F.element_at("ids", -1).alias("last_id")),
    "tokenizer_preview": lambda s, d: K.decode_file(K.encode_file(table(s, d, "benchmark"), "item_id", "text", _path(), special=True), "item_id", "ids", _path()).select("item_id", F.length("text").cast("bigint").alias("n_chars")),
}

_N = "row_number() OVER (ORDER BY doc_id) - 1 AS sample, length(text)::BIGINT AS n, coalesce(list_sum(list_transform(list_filter(string_split(text, ''), lambda x: x <> ''), lambda x: unicode(x))), 0)::BIGINT AS total"
_PROMPTS = {
    "gsm8k": ("c_name || ' Answer:'", "c_mktsegment"), "math": ("c_name || ' Solution:'", "c_mktsegment"), "mathqa": ("c_name || '? Options:' || 'a ) 1 , b ) 2' || ' Answer:'", "c_mktsegment"),
    "asdiv": ("c_mktsegment || ' ' || c_name || ' Answer:'", "c_nationkey::VARCHAR"), "mawps": ("c_name || ' Answer:'", "c_nationkey::VARCHAR"),
    "mmlu_stem": ("c_name || ' Options: ' || c_mktsegment || ', other, ' || c_name || ' Answer:'", "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'other' ELSE c_name END"),
    "ocw": ("c_name || ' Solution:'", "c_mktsegment"), "sat_math": ("c_name || ' Options: ' || 'A 1 B 2' || ' Answer:'", "c_mktsegment"), "svamp": ("c_mktsegment || c_name || ' Answer:'", "c_nationkey::VARCHAR"),
    "bbh": ("c_name", "c_mktsegment"), "gpqa": ("c_name", "c_mktsegment"), "arc_c": ("'Question: ' || c_name || ' Options: ' || c_mktsegment || ', ' || c_name || '. Answer:'", "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END"),
    "hellaswag": ("'Context' || c_name || ' Options: ' || c_mktsegment || ', other, ' || c_name || ' Best Answer:'", "CASE c_custkey % 3 WHEN 0 THEN c_mktsegment WHEN 1 THEN 'other' ELSE c_name END"),
}
SQL = {
    "stream_windows": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H') AS start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY ALL",
    "multiple_choice_train": "WITH p AS (SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY md5('2357:' || c_custkey), c_custkey) <= ceil(count(*) OVER () * 0.2::DOUBLE) AS val FROM customer), q AS (SELECT c_custkey, c_mktsegment FROM p WHERE val), v AS (SELECT DISTINCT c_mktsegment AS v FROM p WHERE NOT val), o AS (SELECT c_custkey, c_mktsegment AS t, v, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('1:' || c_custkey || '|' || v), v) AS r FROM q JOIN v ON v <> c_mktsegment), k AS (SELECT c_custkey, t, v FROM o WHERE r <= 3 UNION ALL SELECT c_custkey, c_mktsegment, c_mktsegment FROM q), s AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY md5('2:' || c_custkey || '|' || v), v) AS n FROM k) SELECT c_custkey, string_agg(v, '|' ORDER BY n) AS choices, '(' || chr((64 + max(n) FILTER (WHERE v = t))::INTEGER) || ')' AS answer FROM s GROUP BY c_custkey",
    "preview_report": "SELECT 'id: ' || doc_id || chr(10) || 'source: ' || source || chr(10) || CASE WHEN length(text) > 400 THEN left(text, 200) || ' ... [' || (length(text) - 400) || ' omitted] ... ' || right(text, 200) ELSE text END AS report FROM documents ORDER BY doc_id LIMIT 20",
    "first_batches": "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 48 AS batch, (row_number() OVER (ORDER BY doc_id) - 1) % 48 AS place FROM documents ORDER BY doc_id LIMIT 144",
    "line_sink": "SELECT md5(text) AS md5, count(*) AS n FROM documents GROUP BY text",
    "metric_log": "SELECT 'toxic' || toxic || '/n' AS name, k::BIGINT AS step, count(*) FILTER (quality < 1)::DOUBLE AS value FROM labels, range(1, 3) t(k) GROUP BY toxic, k",
    "vocab_sidecar": "SELECT count(DISTINCT ch)::BIGINT AS size, 50304::BIGINT AS missing FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> ''",
    "split_reuse": "WITH r AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('2357:' || doc_id), doc_id) <= ceil(count(*) OVER () * 0.01::DOUBLE) AS v FROM documents), u AS (SELECT 'own' AS corpus, CASE WHEN lang = 'de' THEN 'val' ELSE 'train' END AS split, doc_id FROM r UNION ALL SELECT 'none', CASE WHEN v THEN 'val' ELSE 'train' END, doc_id FROM r) SELECT corpus, split, count(*) AS n, min(doc_id) AS first_id FROM u GROUP BY corpus, split",
    "flat_bare": f"{_C} SELECT pos // 4096 AS block, count(*) AS n, sum(tok)::BIGINT AS total, min_by(tok, pos)::BIGINT AS first_token FROM t GROUP BY block",
    "flat_ends": "WITH a AS (SELECT string_agg(text, '' ORDER BY doc_id) AS x FROM documents) SELECT length(x)::BIGINT AS n, left(x, 20) AS head, right(x, 20) AS tail FROM a",
    "indexed_at": f"SELECT {_N} FROM documents",
    "indexed_pair": f"SELECT {_N} FROM documents",
    "whole_files": "WITH t AS (SELECT string_agg(r_name || chr(10), '' ORDER BY r_name) AS x FROM region) SELECT length(x)::BIGINT AS n, md5(x) AS md5 FROM t",
    "all_subsets": "SELECT 'lang=' || lang AS subset, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY lang",
    "shard_files": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents WHERE cast('0x' || substr(md5(doc_id::VARCHAR), 1, 4) AS BIGINT) % 40 BETWEEN 25 AND 36",
    "qa_formats": " UNION ALL ".join(f"SELECT '{k}' AS form, c_custkey, md5({p}) AS prompt_md5, {a} AS answer FROM customer" for k, (p, a) in _PROMPTS.items()),
    "fixed_choice": "SELECT c_custkey, 'BUILDING|AUTOMOBILE|MACHINERY|HOUSEHOLD' AS choices, CASE c_mktsegment WHEN 'BUILDING' THEN '(A)' WHEN 'AUTOMOBILE' THEN '(B)' WHEN 'MACHINERY' THEN '(C)' WHEN 'HOUSEHOLD' THEN '(D)' END AS answer FROM customer",
    "corpus_cut_90_10": "WITH t AS (SELECT doc_id, text, length(text) AS n, coalesce(sum(length(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, floor(sum(length(text)) OVER () * 0.9::DOUBLE) AS edge FROM documents), k AS (SELECT doc_id, text, greatest(0, least(n, edge - start))::BIGINT AS cut FROM t) SELECT doc_id, cut AS n_train, md5(substr(text, cut + 1)) AS val_md5 FROM k",
    "collate_pad": "WITH t AS (SELECT p_partkey, p_name, length(p_name) AS n, (row_number() OVER (ORDER BY p_partkey) - 1) // 16 AS batch FROM part), m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS longest FROM t) SELECT p_partkey, batch, array_to_string(list_concat(list_transform(list_filter(string_split(p_name, ''), lambda x: x <> ''), lambda x: unicode(x)), list_transform(range(longest - n), lambda i: -1)), ' ') AS ids, repeat('1', n) || repeat('0', (longest - n)::BIGINT) AS mask FROM m",
    "indexed_batch": f"WITH t AS (SELECT {_N} FROM documents) SELECT * FROM t WHERE sample >= (SELECT count(*) // 2 FROM t) AND sample < (SELECT count(*) // 2 + 48 FROM t) UNION ALL SELECT * FROM t WHERE sample = 3",
    "multiple_choice_rows": f"""WITH o AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS v, row_number() OVER (ORDER BY md5('2357:' || o_orderkey), o_orderkey) <= ceil(count(*) OVER () * 0.1::DOUBLE) AS val FROM orders),
r AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS place FROM o WHERE NOT val), n AS (SELECT count(*) AS n FROM r),
d AS (SELECT k, o.v AS t, j, floor({sql_uniform(1, "k || '|' || j").replace("cast(k || '|' || j AS VARCHAR)", "k || '|' || j")} * n)::BIGINT AS place FROM o, range(60) x(j), n WHERE val),
m AS (SELECT k, t, r.v AS v, min(j) AS j FROM d JOIN r USING (place) WHERE r.v <> t GROUP BY ALL), f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY j) <= 3),
a AS (SELECT k, t, v FROM f UNION ALL SELECT DISTINCT k, t, t FROM f), s AS (SELECT k, t, list(v ORDER BY md5('2:' || k || '|' || v), v) AS vs FROM a GROUP BY k, t)
SELECT k AS o_orderkey, array_to_string(vs, '|') AS choices, '(' || chr((64 + list_position(vs, t))::INTEGER) || ')' AS answer FROM s""",
    "cosine_columns": "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings), p AS (SELECT a.i AS i, b.i AS j, sum(a.x * b.x) AS s, sum(a.x * a.x) AS sa, sum(b.x * b.x) AS sb FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i) SELECT i, j, round(s / sqrt(sa) / sqrt(sb), 6) AS cosine FROM p",
}
