"""The operators as queries over whole tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm import bpe, decontam, fim, lm, packing, quality, rules, simhash, spelling, suffix, tokens, toxicity, urlfilter
from volspark.llm.common import LOWER, UPPER, table
from volspark.llm.textstats import COUNTS, text_stats


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_removed") > 0).alias("repeated"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = [F.sha2(c.cast("binary"), 256).alias(n) for n, c in (("output_sha256", F.col("output")), ("restored_sha256", fim.restored(F.col("output"), F.col("form"))))]
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op1 that no walk decides: host, path and rule of every page."""
    return urlfilter.parsed(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part of op7 that nothing is learnt for: the counts of every text."""
    return text_stats(table(spark, sf_dir, "documents").select("doc_id", "text"), []).select("doc_id", *COUNTS)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_simhash_dedup, op3_suffix_dedup, op4_token_counts, op5_toxicity, op6_lm_scores,
        op7_quality_rules, op8_quality_classifier, op9_byte_bpe, op10_decontamination, op11_packing, op12_fill_in_middle, op13_spelling_groups, url_rules, quality_counts, pipeline,
    )
}

_LOWER = f"translate({{}}, '{UPPER}', '{LOWER}')"
_FITS = "(host='{0}' OR ends_with(host,'.{0}')) AND starts_with(path,'{1}')"
_CASES = [(v, h, p) for v, h, p in sorted(urlfilter.RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))]
_WORD = r"[^\x20\x09-\x0D]+"

#: The opN queries learn, iterate to a fixpoint, hash by functions or call tokenizers that the SQL engine does not have; tests/llm
#: holds them against brute force. What of them SQL can express is registered apart.
#: The unsigned crc32 of the bytes of x, in hexadecimal, by the table t of its polynomial.
_CRC = "(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x)//2), lambda i: CAST(('0x'||substr(x,CAST(2*i+1 AS INT),2)) AS BIGINT))), lambda h, b: xor(h>>8, t[CAST((xor(h,b)&255)+1 AS INT)])), 4294967295))"
_CRC_TABLE = "SELECT list_transform(range(256), lambda c: list_reduce(list_prepend(CAST(c AS BIGINT), range(8)), lambda v, _: CASE WHEN v&1=1 THEN xor(3988292384, v>>1) ELSE v>>1 END)) AS t"
_BORDER = "CAST(('0x'||substr(h,{},8)) AS BIGINT)%(n+1)"

ORACLE_SQL: dict[str, str] = {
    "op12_fill_in_middle": "WITH d AS (SELECT doc_id, coalesce(text,'') AS text, sha256('7:'||coalesce(CAST(doc_id AS VARCHAR),'')) AS h FROM documents),"
    " u AS (SELECT *, regexp_extract_all(text, '[^\\n]*\\n|[^\\n]+') AS us FROM d), v AS (SELECT *, CAST(len(us) AS BIGINT) AS n FROM u),"
    f" w AS (SELECT *, least({_BORDER.format(1)},{_BORDER.format(9)}) AS a, greatest({_BORDER.format(1)},{_BORDER.format(9)}) AS b, CASE WHEN text='' OR contains(text,'<P>') OR contains(text,'<S>') OR contains(text,'<M>') THEN 'plain' WHEN CAST(('0x'||substr(h,25,8)) AS BIGINT)%100<50 THEN 'spm' ELSE 'psm' END AS form FROM v),"
    " x AS (SELECT *, array_to_string(us[1:a],'') AS p, array_to_string(us[a+1:b],'') AS m, array_to_string(us[b+1:],'') AS s FROM w)"
    " SELECT doc_id, n, form, CASE WHEN form<>'plain' THEN length(p) END AS prefix_chars, CASE WHEN form<>'plain' THEN length(m) END AS middle_chars,"
    " sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>'||p||'<S>'||s||'<M>'||m ELSE '<S>'||s||'<P>'||p||'<M>'||m END) AS output_sha256, sha256(text) AS restored_sha256 FROM x",
    "op13_spelling_groups": f"WITH RECURSIVE crc AS ({_CRC_TABLE}),"
    f" r AS (SELECT coalesce(CAST(doc_id AS VARCHAR),'') AS doc, unnest(regexp_extract_all({_LOWER.format("coalesce(text,'')")}, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents),"
    f" o AS (SELECT doc, run, count(*) AS c FROM r WHERE length(run)>=7 GROUP BY 1,2), g AS (SELECT run, c, {_CRC} AS h FROM (SELECT *, hex(encode(doc||chr(58)||run)) AS x FROM o), crc),"
    " e AS (SELECT c, CASE WHEN h%31=0 THEN substr(run,1,CAST(h%length(run) AS INT))||substr(run,CAST(h%length(run) AS INT)+2) ELSE run END AS word FROM g),"
    " w AS MATERIALIZED (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM e WHERE length(word)>=7 GROUP BY 1 HAVING sum(c)>=2),"
    " d AS MATERIALIZED (SELECT word, n, p, substr(word,1,CAST(p-1 AS INT))||substr(word,CAST(p+1 AS INT)) AS v FROM w, unnest(range(1,length(word)+1)) q(p)),"
    " y AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.v=b.v AND a.p=b.p AND a.word<>b.word UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.v=w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.v=w.word),"
    " z AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, struct_pack(a := -m, b := near)) AS near FROM y GROUP BY 1),"
    " f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near,0) AS n_near, CASE WHEN m>=10*n THEN near END AS form, CASE WHEN m>=10*n THEN m END AS form_n FROM w LEFT JOIN z ON z.word=w.word),"
    " k AS (SELECT word, word AS here, 0 AS depth FROM f UNION ALL SELECT k.word, f.form, depth+1 FROM k JOIN f ON f.word=k.here WHERE f.form IS NOT NULL)"
    " SELECT f.word, form, root, n, n_near, form_n FROM f JOIN (SELECT word, arg_max(here, depth) AS root FROM k GROUP BY 1) t ON t.word=f.word",
    "url_rules": "SELECT page_id, host, path, CASE "
    + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{h + p}'" for _, h, p in _CASES)
    + " END AS rule, CASE "
    + " ".join(f"WHEN {_FITS.format(h, p)} THEN '{v}'" for v, h, p in _CASES)
    + f" END AS verdict FROM (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(t,'^[^/?#]*'),'')")} AS host, coalesce(regexp_extract(t,'^[^/?#]*([^?#]*)',1),'') AS path FROM (SELECT page_id, CASE WHEN contains(url,'://') THEN substr(url, strpos(url,'://')+3) END AS t FROM pages))",
    "quality_counts": f"WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text,'') AS text FROM documents), w AS (SELECT r, doc_id, text, regexp_extract_all(text,'{_WORD}') AS ws FROM d),"
    " g AS (SELECT r, unnest(range(1,len(ws)-1)) AS i, ws FROM w WHERE len(ws)>2), h AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i]||' '||ws[i+1]||' '||ws[i+2]) AS n FROM g),"
    " c AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i,i+1,i+2]) AS p FROM h WHERE n>1) GROUP BY 1),"
    f" l AS (SELECT r, count(*)-count(DISTINCT x) AS n FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x,'{_WORD}') GROUP BY 1)"
    " SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))),0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text,'[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n,0) AS n_dup_lines, coalesce(c.n,0) AS n_repeat_words"
    " FROM w LEFT JOIN c ON c.r=w.r LEFT JOIN l ON l.r=w.r",
}
