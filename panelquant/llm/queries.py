"""One query per operator over its whole table, with production parameters, and SQL twins where SQL can express them."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from panelquant.llm import decontaminate, language_id, lexical, licenses, merkle, mixing, ngram_join, sharding, suffix_dedup, transport, url_filters, warc, wavelet
from panelquant.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return deco


SHARDS = [f"shard-{k:04d}" for k in range(128)]


@query("op1_permutation_sharding")
def op1(spark, d):
    """Slot and shard of every document, and its shard after the last one is lost."""
    docs = table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"))
    return sharding.place(sharding.place(docs, SHARDS, slot="slot"), SHARDS[:-1], shard="shard_after_loss")


#: Target language shares of the mix.
LANGUAGES = {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2}
SWEEPS, BUDGET = 200, 0.5


def _mix_sql(sweeps: int = 30) -> str:
    """The fit unrolled until it stands still, one step per common table expression, and the calibration."""
    w = r"[^\x20\x09-\x0D]+"
    of = lambda c: f"(length(text) - length(regexp_replace(text, '[{c}]', '', 'g')))"
    out = [f"""d0 AS (SELECT doc_id, text, coalesce(source, '') AS source, coalesce(lang, '') AS lang, CAST(coalesce(len(regexp_extract_all(text, '{w}')), 0) AS BIGINT) AS n_tokens FROM documents)""",
           f"""d AS (SELECT doc_id, source, lang, n_tokens, CASE WHEN text IS NULL THEN 'prose' WHEN {of('|')} * 5 >= greatest(n_tokens, 1) THEN 'table' WHEN {of('0-9')} * 20 >= greatest(length(text), 1) THEN 'numeric'
               WHEN {of(chr(92) + 'n')} * 12 >= greatest(n_tokens, 1) THEN 'lines' ELSE 'prose' END AS topic FROM d0)""",
           "cells AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(n_tokens) AS BIGINT) AS n FROM d GROUP BY ALL)"]
    named = ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in LANGUAGES.items())
    lang = f"""SELECT lang, CASE WHEN given IS NULL THEN t / whole ELSE given * ((1 - rest / whole) / given_sum) END AS target FROM (SELECT *, sum(t) OVER () AS whole, coalesce(sum(CASE WHEN given IS NULL THEN t END) OVER (), 0) AS rest,
        sum(given) OVER () AS given_sum FROM (SELECT lang, pow(sum(n)::DOUBLE, 0.5) AS t FROM cells GROUP BY 1 HAVING sum(n) > 0) LEFT JOIN (VALUES {named}) g(lang, given) USING (lang))"""
    for m, t in (("source", "SELECT source, pow(sum(n)::DOUBLE, 0.5) AS target FROM cells GROUP BY 1"), ("lang", lang), ("topic", "SELECT topic, pow(sum(n)::DOUBLE, 0.75) AS target FROM cells GROUP BY 1")):
        out += [f"t0_{m} AS (SELECT * FROM ({t}) x WHERE {m} IN (SELECT {m} FROM cells WHERE n > 0))", f"t_{m} AS MATERIALIZED (SELECT {m}, target / (SELECT sum(target) FROM t0_{m}) AS share FROM t0_{m})"]
    out.append("w0 AS (SELECT *, n::DOUBLE AS w FROM cells)")
    k = 0
    for _ in range(sweeps):
        for m in ("source", "lang", "topic"):
            k += 1
            out.append(f"""w{k} AS MATERIALIZED (SELECT a.source, a.lang, a.topic, a.n, CASE WHEN s.s > 0 THEN a.w * (coalesce(t.share, 0) / s.s) ELSE 0 END AS w FROM w{k - 1} a
                JOIN (SELECT {m}, sum(w) AS s FROM w{k - 1} GROUP BY 1) s USING ({m}) LEFT JOIN t_{m} t USING ({m}))""")
    out.append(f"""sc AS MATERIALIZED (SELECT greatest(0.0, max(({BUDGET} * (SELECT sum(n) FROM cells) - (tot - rest_n)) / rest_w)) AS s FROM (SELECT sum(n) OVER () AS tot, sum(n) OVER o AS rest_n, sum(w) OVER o AS rest_w
        FROM w{k} WHERE n > 0 AND w > 0 WINDOW o AS (ORDER BY n / w DESC)))""")
    return "WITH " + ",\n".join(out) + f"""
        SELECT doc_id, source, lang, topic, n_tokens, round(p, 9) AS p, u < p AS sampled FROM (
        SELECT d.doc_id, d.source, d.lang, d.topic, d.n_tokens, CASE WHEN n > 0 THEN least(1.0, (SELECT s FROM sc) * w / n) ELSE 0.0 END AS p,
        ('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)} AS u FROM d JOIN w{k} c USING (source, lang, topic)) x"""


@query("op4_raking_mix", _mix_sql())
def op4(spark, d):
    """Probability and decision of every document."""
    m = mixing.mix(table(spark, d, "documents"), LANGUAGES, budget=BUDGET, sweeps=SWEEPS)
    return m.select("doc_id", "source", "lang", "topic", "n_tokens", F.round("p", 9).alias("p"), "sampled")


#: Fixed values of the query's contract.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def _url_sql() -> str:
    """Rules and link groups; groups by a recursive closure over the distinct links."""
    host = lambda u: f"coalesce(translate(regexp_extract({u}, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = lambda u: f"coalesce(regexp_extract({u}, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '')"
    node = lambda u: f"CASE WHEN contains({u}, '://') THEN lower(regexp_extract({u}, '^(.*?)://', 1, 's')) || '://' || {host(u)} || regexp_extract({u}, '^.*?://[^/?#]*([^#]*)', 1, 's') END"
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)
    best = lambda src, key: f"""(SELECT x.*, b.rule, b.v AS rule_verdict FROM {src} x LEFT JOIN (SELECT host, path, arg_max(h || p, length(h) + length(p) + length(h) / 1000.0) AS rule,
        arg_max(v, length(h) + length(p) + length(h) / 1000.0) AS v FROM (SELECT DISTINCT host, path FROM {src}) u JOIN rules r ON (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p) GROUP BY 1, 2) b
        ON x.host = b.host AND x.path = b.path)"""
    return rf"""WITH RECURSIVE rules(v, h, p) AS (VALUES {rules}),
        pg AS (SELECT page_id, url, html, {host('url')} AS host, {path('url')} AS path, {node('url')} AS node FROM pages),
        raw AS (SELECT node AS src, regexp_extract(regexp_extract(html, '<link\b[^>]*\brel\s*=\s*["'']?canonical\b[^>]*>', 0, 'is'), '\bhref\s*=\s*["'']?([^"''\s>]+)', 1, 'is') AS t FROM pg
                UNION ALL SELECT node, regexp_extract(regexp_extract(html, '<meta\b[^>]*\bhttp-equiv\s*=\s*["'']?refresh\b[^>]*>', 0, 'is'), '\burl\s*=\s*["'']?([^"''\s>]+)', 1, 'is') FROM pg),
        e0 AS (SELECT DISTINCT src, {node('t')} AS dst FROM raw),
        e AS (SELECT src, dst FROM e0 WHERE src <> dst UNION SELECT dst, src FROM e0 WHERE src <> dst),
        reach(a, b) AS (SELECT src, src FROM e UNION SELECT r.a, e.dst FROM reach r JOIN e ON r.b = e.src),
        grp AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY 1),
        mem0 AS (SELECT node, component, {host('node')} AS host, {path('node')} AS path FROM grp),
        mem AS (SELECT * FROM {best('mem0', 'node')}),
        dec AS (SELECT component, min(CASE rule_verdict WHEN 'allow' THEN 0 WHEN 'block' THEN 1 END) AS d FROM mem GROUP BY 1),
        al AS (SELECT node, CASE d WHEN 0 THEN 'allow' WHEN 1 THEN 'block' END AS alias_verdict FROM mem JOIN dec USING (component) WHERE rule_verdict IS NULL)
        SELECT page_id, x.host, x.path, rule, coalesce(rule_verdict, alias_verdict, 'allow') AS verdict FROM {best('pg', 'page_id')} x LEFT JOIN al USING (node)"""


@query("op10_url_filters", _url_sql())
def op10(spark, d):
    """Verdict of every page under the rules, links taken from the pages' own canonical and refresh tags."""
    pages = table(spark, d, "pages")
    return url_filters.judge_urls(pages, RULES, url_filters.links_from_html(pages, resolve=True))


@query("op2_transport_stream")
def op2(spark, d):
    """Every text as a stored transport stream, read back and digested."""
    return transport.stored_digest(table(spark, d, "documents"))


@query("op3_ppm_language_id")
def op3(spark, d):
    """Language of every document, from trees trained on the training fold."""
    docs = table(spark, d, "documents")
    learn = language_id.in_training(F.col("doc_id"))
    model = language_id.train(docs.where(learn))
    return language_id.predict(docs, model).select("doc_id", (~learn).alias("held_out"), "lang_pred", "score", "bits_per_byte")


_FOLDED = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op8_decontamination", f"""WITH dw AS (SELECT doc_id, coalesce({_FOLDED}, []) AS w FROM documents), bw AS (SELECT item_id::VARCHAR AS item_id, {_FOLDED} AS w FROM benchmark WHERE text IS NOT NULL),
    win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + 9], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM bw WHERE len(w) > 0)),
    dwin AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
    hit AS (SELECT doc_id, i, dwin.k, item_id FROM dwin JOIN win USING (k, g)),
    hw AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY 1),
    it AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS s FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
    SELECT doc_id, len(w) AS n_words, coalesce(hw.n, 0) AS n_hit, coalesce(it.n, 0) AS n_items, sha256(coalesce(it.s, '')) AS items_sha256, coalesce(hw.n, 0) > 0 AS contaminated
    FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN it USING (doc_id)""")
def op8(spark, d):
    """Hit words and items of every document."""
    s = decontaminate.scan(table(spark, d, "documents"), table(spark, d, "benchmark"), window=10)
    return s.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


_B32 = "array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31))::INT, 1) FOR i IN range(32)], '')"


@query("op7_warc", f"""WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages), f AS (SELECT h, n, min(page_id) AS first FROM p GROUP BY 1, 2)
    SELECT page_id, n::BIGINT AS payload_bytes, {_B32} AS payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p JOIN f USING (h, n)""")
def op7(spark, d):
    """Pages written as archives and read back by byte ranges."""
    r = warc.read(warc.write(table(spark, d, "pages"), least=0), payloads=False)
    return r.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_wavelet_tokens")
def op9(spark, d):
    """Token shards of all documents, read back."""
    return wavelet.read(wavelet.write(table(spark, d, "documents"), tokenizer_path(), end_id=2))


@query("op5_suffix_dedup")
def op5(spark, d):
    """Bytes of every document that repeat 50-byte strings of earlier documents, and what is left."""
    return suffix_dedup.dedup_passages(table(spark, d, "documents"))


_GRAMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"


@query("op6_ngram_jaccard_join", f"""WITH RECURSIVE w AS (SELECT doc_id, {_GRAMS} AS w FROM documents),
    g AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') || CASE WHEN len(w) < 5 THEN ' ' || len(w)::VARCHAR || chr(0) ELSE '' END AS g FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
    o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    e AS MATERIALIZED (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
    r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
    SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a, min(b) AS c FROM r GROUP BY 1) m ON m.a = w.doc_id""")
def op6(spark, d):
    """Near-copy component of every document."""
    return ngram_join.near_duplicates(table(spark, d, "documents")).select("doc_id", "n_shingles", "component_id")


def _merkle_sql(levels: int = 6, crown_levels: int = 3) -> str:
    """The trees unrolled: enough levels for 16 million documents of a source and 4,096 sources."""
    f = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR))::VARCHAR || ':' || {c}::VARCHAR, '-')"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    h = lambda t: f"sha256({f('doc_id')} || {f('source')} || {f('lang')} || {f('n_chars')} || {f(t)})"
    byte = "list_reduce([xor(a, ord(c)::UBIGINT)] || [0::UBIGINT for i in range(8)], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)"
    crc = f"xor(list_reduce([4294967295::UBIGINT] || [ord(c)::UBIGINT for c in string_split(doc_id::VARCHAR, '')], lambda a, b: {byte.replace('ord(c)::UBIGINT', 'b')}), 4294967295::UBIGINT)"
    out = [f"d AS MATERIALIZED (SELECT doc_id, coalesce('=' || source, '') AS g, {h('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {h(low)} ELSE {h('text')} END AS now FROM documents)",
           "a0 AS MATERIALIZED (SELECT g, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, h FROM d)",
           "x0 AS (SELECT *, row_number() OVER () AS row FROM (SELECT d.doc_id, d.g, d.h, d.now, row_number() OVER (PARTITION BY d.g ORDER BY d.doc_id NULLS FIRST, d.h) - 1 AS pos FROM d))",
           "p0 AS MATERIALIZED (SELECT row, doc_id, g, h AS leaf, pos, now, '' AS proof FROM x0)"]

    def level(a, p, k, keep):
        own = f"""{p}{k + 1} AS MATERIALIZED (SELECT p.row, {keep}, p.pos // 16 AS pos, CASE WHEN max(c.n) = 1 THEN any_value(p.now) ELSE sha256(string_agg(CASE WHEN n.pos = p.pos THEN p.now ELSE n.h END, '' ORDER BY n.pos)) END AS now,
            any_value(p.proof) || coalesce(string_agg(CASE WHEN n.pos <> p.pos THEN n.h END, '' ORDER BY n.pos), '') AS proof FROM {p}{k} p JOIN {a}{k} n ON n.g = p.g AND n.pos // 16 = p.pos // 16
            JOIN (SELECT g, count(*) AS n FROM {a}{k} GROUP BY 1) c ON c.g = p.g GROUP BY ALL)"""
        up = f"{a}{k + 1} AS MATERIALIZED (SELECT g, pos // 16 AS pos, CASE WHEN sum(count(*)) OVER (PARTITION BY g) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {a}{k} GROUP BY g, pos // 16)"
        return [own, up]

    for k in range(levels):
        out += level("a", "p", k, "p.doc_id, p.g, p.leaf")
    out += ["b0 AS MATERIALIZED (SELECT '' AS g, row_number() OVER (ORDER BY g) - 1 AS pos, h, g AS name FROM a%d)" % levels,
            "q0 AS MATERIALIZED (SELECT p.row, p.doc_id, p.leaf, b.h AS subroot, b.g AS g, b.pos, p.now, p.proof FROM p%d p JOIN b0 b ON b.name = p.g)" % levels]
    for k in range(crown_levels):
        out += level("b", "q", k, "p.doc_id, p.leaf, p.subroot, p.g")
    return "WITH " + ",\n".join(out) + f"""
        SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = b.h AS verified FROM q{crown_levels} JOIN b{crown_levels} b USING (g)"""


@query("op11_merkle_manifest", _merkle_sql())
def op11(spark, d):
    """Roots and proof of every document, and what each proof leads to where a fifth of the texts is tampered with."""
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, d, "documents"), {"text": F.when(hit, low).otherwise(F.col("text"))}).drop("steps")


def _license_sql() -> str:
    """Every start at which a template's mandatory words stand in place, by one join on words."""
    t = licenses.BASE + licenses.NOTICES
    word = ", ".join(f"({k}, {p}, '{w.decode()}', {p in x.must})" for k, x in enumerate(t) for p, w in enumerate(x.words))
    head = ", ".join(f"({k}, '{x.label}', {x.base}, {len(x.words)}, {len(x.must)}, {x.least[0]}, {x.least[1]})" for k, x in enumerate(t))
    return f"""WITH tw(k, p, w, must) AS (VALUES {word}), th(k, label, base, n, musts, num, den) AS (VALUES {head}),
    d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce({_FOLDED}, []) AS w FROM documents),
    dw AS (SELECT row, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM d),
    al AS (SELECT row, k, i - p AS start, count(*) AS c FROM dw JOIN tw USING (w) JOIN th USING (k) GROUP BY row, k, i - p HAVING count(*) FILTER (WHERE must) = any_value(musts)),
    ok AS (SELECT row, label, base, start, c / n AS share FROM al JOIN th USING (k) WHERE c * den >= n * num)
    SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
    FROM d LEFT JOIN (SELECT row, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM ok GROUP BY 1) x USING (row)"""


@query("op13_license_scan", _license_sql())
def op13(spark, d):
    """Licenses named in every document, places of the base phrases, and the best share of a notice."""
    return licenses.summary(licenses.scan(table(spark, d, "documents")))


_TERMS = r"regexp_extract_all(translate(regexp_replace(text, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ ]+')"


@query("op12_lexical_search", f"""WITH dt AS MATERIALIZED (SELECT row, doc_id, t, count(*) AS tf FROM (SELECT row_number() OVER () AS row, doc_id, unnest({_TERMS}) AS t FROM documents WHERE text IS NOT NULL) GROUP BY ALL),
    n AS MATERIALIZED (SELECT row, sum(tf)::BIGINT AS n FROM dt GROUP BY 1), s AS (SELECT count(*)::BIGINT AS nd, sum(n)::BIGINT AS l FROM n),
    m AS (SELECT row, 10 + (90 * n * nd) // l AS m FROM n, s),
    w AS (SELECT t, floor(1000 * ln((2 * nd + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM (SELECT t, count(*) AS df FROM dt GROUP BY 1), s),
    it AS (SELECT DISTINCT item, item_id, t FROM (SELECT row_number() OVER () AS item, item_id, unnest({_TERMS}) AS t FROM benchmark WHERE text IS NOT NULL)),
    sc AS (SELECT item, item_id, row, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score FROM it JOIN w USING (t) JOIN dt USING (t) JOIN m USING (row) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM sc WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10""")
def op12(spark, d):
    """The ten best documents for every benchmark item."""
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"))
