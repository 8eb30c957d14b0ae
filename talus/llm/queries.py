"""The registered queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talus.llm.common import table
from talus.llm.decontaminate import BenchmarkIndex, contamination
from talus.llm.divergence import source_divergence
from talus.llm.exact_dedup import exact_duplicates
from talus.llm.licenses import license_sql, scan_licenses
from talus.llm.line_dedup import line_dedup
from talus.llm.minhash import near_duplicates
from talus.llm.mixing import mix_sources
from talus.llm.packing import pack_documents
from talus.llm.prefix_trie import prefix_trie
from talus.llm.quality import score_quality
from talus.llm.toxicity import score_toxicity
from talus.llm.url_filter import Rule, filter_urls
from talus.llm.warc import archive_pages

URL_RULES = [
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    return out.select("doc_id", "n_lines", "n_removed", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("text_sha256"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"), keep="max")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def proximity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items with windows all of whose words stand within twenty words of a document, in any order."""
    return BenchmarkIndex(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).proximity_report(slop=20)


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = prefix_trie(table(spark, sf_dir, "conversations"))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_toxicity, op2_line_dedup, op3_exact_dedup, op4_decontamination, op5_minhash, op6_license_scan, op7_quality, op8_packing, op9_url_filter, op10_warc, op11_mixing, op12_prefix_trie, op13_source_divergence, proximity_matches)}


_LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def oracle_sql() -> dict[str, str]:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    return {
        "op2_line_dedup": r"""
            WITH r AS (SELECT doc_id, i, ls[i] line, trim(ls[i], chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) t
                       FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents))),
            c AS (SELECT doc_id, i, t, row_number() OVER w pos, len(string_split_regex(t, '[ \t\r\x0b\x0c]+')) n, sum(len(string_split_regex(t, '[ \t\r\x0b\x0c]+'))) OVER w upto
                  FROM r WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
            p AS (SELECT a.doc_id, a.pos b, z.pos e FROM c a JOIN c z ON a.doc_id = z.doc_id AND z.pos BETWEEN a.pos AND a.pos + 50 AND z.upto - a.upto + a.n >= 50),
            runs AS (SELECT doc_id, b, min(e) e FROM p GROUP BY doc_id, b UNION SELECT doc_id, max(b), e FROM p GROUP BY doc_id, e),
            k AS (SELECT x.doc_id, b, e, string_agg(t, chr(10) ORDER BY pos) run FROM runs x JOIN c ON c.doc_id = x.doc_id AND pos BETWEEN b AND e GROUP BY ALL),
            f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, b) nth FROM k),
            g AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) pos FROM f WHERE nth > 1),
            h AS (SELECT c.doc_id, c.i, lead(c.pos) OVER w = c.pos + 1 AND lead(c.i) OVER w IS NOT NULL joined, lead(c.i) OVER w upto FROM g JOIN c USING (doc_id, pos) WINDOW w AS (PARTITION BY c.doc_id ORDER BY c.pos)),
            gone AS (SELECT doc_id, unnest(range(i, CASE WHEN joined THEN upto ELSE i + 1 END)) i FROM h),
            kept AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i), '') text FROM r ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
            SELECT doc_id, (SELECT count(*) FROM c WHERE c.doc_id = d.doc_id) n_lines, (SELECT count(*) FROM g WHERE g.doc_id = d.doc_id) n_removed,
                   length(coalesce(kept.text, ''))::BIGINT n_chars, sha256(coalesce(kept.text, '')) text_sha256
            FROM documents d LEFT JOIN kept USING (doc_id)""",
        "op3_exact_dedup": f"""
            WITH n AS (SELECT doc_id, {_LOWER.format("text")} norm FROM documents)
            SELECT doc_id, max(doc_id) OVER w keep_id, count(*) OVER w group_size,
                   doc_id IS NOT DISTINCT FROM max(doc_id) OVER w kept, sha256(norm) text_sha256
            FROM n WINDOW w AS (PARTITION BY norm)""",
        "op4_decontamination": f"""
            WITH d AS (SELECT doc_id, {_WORDS.format("text")} w FROM documents),
            i AS (SELECT item_id::VARCHAR item_id, {_WORDS.format("text")} w FROM benchmark),
            win AS (SELECT DISTINCT item_id, least(len(w), 10) width, unnest(list_transform(range(0, len(w) - least(len(w), 10) + 1), lambda s: array_to_string(w[s + 1 : s + least(len(w), 10)], ' '))) phrase FROM i WHERE len(w) > 0),
            spot AS (SELECT doc_id, width, unnest(range(0, len(w) - width + 1)) spot_at, w FROM d, (SELECT DISTINCT width FROM win) WHERE len(w) >= width),
            occ AS (SELECT DISTINCT doc_id, spot_at, s.width, item_id FROM (SELECT doc_id, spot_at, width, array_to_string(w[spot_at + 1 : spot_at + width], ' ') phrase FROM spot) s JOIN win USING (width, phrase)),
            hit AS (SELECT doc_id, count(DISTINCT p) n_hit FROM (SELECT doc_id, unnest(range(spot_at, spot_at + width)) p FROM occ) GROUP BY doc_id),
            ids AS (SELECT doc_id, count(DISTINCT item_id) n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) names FROM occ GROUP BY doc_id)
            SELECT doc_id, len(w)::BIGINT n_words, coalesce(n_hit, 0)::BIGINT n_hit, coalesce(n_items, 0)::BIGINT n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
            FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)""",
        "op5_minhash": f"""
            WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+') w FROM documents),
            e AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                         ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda k: array_to_string(w[k : k + 2], ' '))) END sh FROM d),
            s AS (SELECT doc_id, len(sh) n, unnest(sh) x FROM e),
            k AS (SELECT a.doc_id a, b.doc_id b, any_value(a.n) na, any_value(b.n) nb, count(*) shared FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
            links AS (SELECT a, b FROM k WHERE 100 * shared >= 85 * (na + nb - shared) UNION SELECT b, a FROM k WHERE 100 * shared >= 85 * (na + nb - shared)),
            reach(node, comp) AS (SELECT doc_id, doc_id FROM e UNION SELECT l.b, r.comp FROM reach r JOIN links l ON l.a = r.node WHERE r.comp < l.b),
            c AS (SELECT node, min(comp) comp FROM reach GROUP BY node)
            SELECT doc_id, len(sh)::BIGINT n_shingles, comp component_id, doc_id = comp kept FROM e JOIN c ON node = doc_id""",
        "op6_license_scan": license_sql(),
        "op9_url_filter": f"""
            WITH rules(verdict, r_host, r_path) AS (VALUES {rules}),
            p AS (SELECT page_id, {_LOWER.format(r"regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")} host,
                         coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
            u AS (SELECT DISTINCT host, path FROM p),
            m AS (SELECT u.*, r_host || r_path AS rule, verdict,
                         row_number() OVER (PARTITION BY host, path ORDER BY length(r_host) DESC, length(r_path) DESC, verdict DESC) rn
                  FROM u JOIN rules ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path))
            SELECT page_id, p.host, p.path, rule, coalesce(verdict, 'allow') verdict
            FROM p LEFT JOIN m ON p.host = m.host AND p.path = m.path AND rn = 1""",
        "op10_warc": """
            WITH n AS (SELECT page_id, coalesce(html, '') body FROM pages),
            f AS (SELECT page_id, octet_length(encode(body)) payload_bytes, sha256(body) payload_digest,
                         min(page_id) OVER (PARTITION BY body) lowest FROM n)
            SELECT page_id, payload_bytes::BIGINT payload_bytes, payload_digest,
                   CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN 'revisit' ELSE 'response' END record_type,
                   CASE WHEN payload_bytes >= 100 AND page_id <> lowest THEN lowest END refers_to
            FROM f""",
        "op11_mixing": r"""
            WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT size,
                              md5('mix/' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) k FROM documents),
            s AS (SELECT source, sum(size)::BIGINT source_size FROM d GROUP BY source),
            r AS (SELECT *, 3 * source_size cap, [1, 2, 3][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] w FROM s),
            a AS (SELECT *, cap / w::DOUBLE ratio, sum(cap) OVER o - cap cap_before, sum(w) OVER o - w w_before
                  FROM r WINDOW o AS (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
            v AS (SELECT *, ((SELECT sum(source_size) FROM s) - cap_before)::DOUBLE / ((SELECT sum(w) FROM r) - w_before) AS stage FROM a),
            lv AS (SELECT stage FROM v WHERE stage <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1),
            t AS (SELECT source, source_size, cap, least(cap::DOUBLE, (SELECT stage FROM lv) * w) target FROM r),
            b AS (SELECT *, least(floor(target + 0.5)::BIGINT, cap) budget FROM t),
            e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END again FROM b),
            p AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ahead FROM d)
            SELECT doc_id, size, source_size, target, (again * size + least(size, greatest(budget - again * source_size - ahead, 0)))::BIGINT taken
            FROM p JOIN e ON p.source IS NOT DISTINCT FROM e.source""",
        "op12_prefix_trie": """
            WITH t AS (SELECT conv_id, md5(length(r) || ':' || r || x) k, octet_length(encode(x)) nb, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, r, x) pos
                       FROM (SELECT conv_id, turn, coalesce(role, '') r, coalesce(text, '') x FROM conversations WHERE conv_id IS NOT NULL)),
            c AS (SELECT DISTINCT conv_id, xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT),
                         lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, 3988292384 * (p & 1))))) % 9 h FROM t),
            b AS (SELECT c.conv_id, 0 part, pos, k, nb FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND pos <= h UNION ALL
                  SELECT conv_id, 1, pos, k, nb FROM c JOIN t USING (conv_id) WHERE pos > h),
            g AS (SELECT conv_id, coalesce(list(k ORDER BY part, pos) FILTER (k IS NOT NULL), []) ks, coalesce(list(nb ORDER BY part, pos) FILTER (k IS NOT NULL), []) nbs FROM c LEFT JOIN b USING (conv_id) GROUP BY conv_id),
            m AS (SELECT conv_id, ks, nbs, unnest(range(0, len(ks) + 1)) d FROM g),
            a AS (SELECT ks[1:d] pre, d, min(conv_id) conv_id, count(*) n_convs, (count(*) - 1) * coalesce(any_value(nbs[d]), 0) own,
                         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = len(ks)), '') ids FROM m GROUP BY 1, 2),
            z AS (SELECT p.pre, count(*) n FROM a JOIN a p ON a.d = p.d + 1 AND a.pre[1:p.d] = p.pre GROUP BY p.pre),
            u AS (SELECT pre, d, own, n IS NULL leaf FROM a LEFT JOIN z USING (pre)),
            s AS (SELECT pre[1:i] pre, sum(own) saved, count_if(leaf) leaves FROM (SELECT pre, own, leaf, unnest(range(0, d + 1)) i FROM u) GROUP BY 1)
            SELECT a.conv_id, a.d depth, p.conv_id parent_conv_id, a.n_convs, coalesce(z.n, 0)::BIGINT n_children, leaves::BIGINT n_leaves, saved::BIGINT saved_tokens, sha256(a.ids) ends_sha256
            FROM a JOIN s USING (pre) LEFT JOIN z USING (pre) LEFT JOIN a p ON p.d = a.d - 1 AND p.pre = a.pre[1:a.d - 1] AND a.d > 0""",
        "op13_source_divergence": f"""
            WITH d AS (SELECT row_number() OVER () id, coalesce(lang, '') lang, coalesce(source, '') AS source, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') terms FROM documents),
            c AS (SELECT lang, source, term, count(*) n, count(DISTINCT id) docs FROM (SELECT id, lang, source, unnest(terms) term FROM d) GROUP BY ALL),
            k AS (SELECT lang, term, sum(n) n FROM c GROUP BY ALL HAVING sum(docs) >= 3),
            l AS (SELECT lang, count(*) v, sum(n) total FROM k GROUP BY lang),
            g AS (SELECT d.lang, d.source, coalesce(any_value(total), 0) total FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(c.n) total FROM c JOIN k USING (lang, term) GROUP BY ALL) x USING (lang, source) GROUP BY ALL),
            p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 1)) // (g.total + v)::HUGEINT p, 1 + (1000000000::HUGEINT * (k.n + 1)) // (l.total + v)::HUGEINT lp
                  FROM g JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
            f AS (SELECT a.lang, a.source, b.source item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            r AS (SELECT a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
                  UNION ALL SELECT lang, source, 'term', term, (p - lp) * (p - lp) // lp FROM p WHERE n > 0 AND p > lp)
            SELECT lang, source, part, item, value::BIGINT AS value, nth::INTEGER AS rank
            FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY r.value DESC, item) nth FROM r) WHERE part = 'pair' OR nth <= 200""",
    }
