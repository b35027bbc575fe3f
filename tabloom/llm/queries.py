"""One registered query per operator: its production parameters over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from checks import Registry, table
from tabloom.llm import collocations, fingerprint, lattice, licenses, line_chunks, ngram_join, packing, paragraphs, pieces, spelling, toxicity, warc
from tabloom.llm import quality_rules as quality

reg = Registry()
add = reg.add


def measured_sql(docs: str = "documents") -> str:
    """Statements that give ``m``: the measures of the quality rules for every row of ``docs``."""
    return f"""
w AS (SELECT doc_id, lang, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM {docs}),
win AS (SELECT doc_id, i, ws[i:i + 7] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
gaps AS (SELECT doc_id, least(8, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8)) AS fresh FROM twice),
rep AS (SELECT doc_id, sum(fresh) AS n FROM gaps GROUP BY 1),
ln AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
m0 AS (SELECT w.doc_id, w.lang, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
  coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::BIGINT AS n_shouts
  FROM w JOIN ln USING (doc_id) LEFT JOIN rep USING (doc_id)),
m AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m0)"""


def kept_sql(docs: str = "documents") -> str:
    """Statements that end in ``q``: ``m`` with the verdict of the calibrated rules."""
    rules = quality.RULES
    share = {r.name: "CASE WHEN {1} > 0 THEN {0} / {1} ELSE 0 END".format(*(f"{x}::DOUBLE" for x in r.value.split(" / "))) for r in rules}
    grid = ", ".join(f"('{r.name}', {i}, {c}::DOUBLE)" for r in rules for i, c in enumerate(r.cutoffs))
    p = repr(quality.RISK / len(rules))
    cuts = ", ".join(f"max(cutoff) FILTER (WHERE rule = '{r.name}') AS cut_{r.name}" for r in rules)
    over = " OR ".join(f"coalesce({share[r.name]} > cut_{r.name}, false)" for r in rules)
    values = " UNION ALL ".join(f"SELECT doc_id, lang, '{r.name}' AS rule, {share[r.name]} AS v FROM m WHERE NOT base_failed" for r in rules)
    return f"""{measured_sql(docs)},
grid(rule, step, cutoff) AS (VALUES {grid}),
v AS ({values}),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
lost AS (SELECT lang, rule, step, cutoff, count(*) AS n, count(*) FILTER (WHERE v.v > cutoff) AS k
  FROM v JOIN good USING (doc_id) JOIN grid USING (rule) GROUP BY ALL),
tail AS (SELECT lang, rule, step, sum(exp(lgamma(n + 1) - lgamma(i + 1) - CASE WHEN i < n THEN lgamma(n - i + 1) ELSE 0 END
    + i * ln({p}) + (n - i) * ln(1 - {p}))) AS pv FROM (SELECT *, unnest(range(0, k + 1)) AS i FROM lost WHERE k < n * {p}) GROUP BY ALL),
seq AS (SELECT lost.*, coalesce(pv, 1) <= {quality.DELTA / len(rules)!r} / (SELECT count(DISTINCT coalesce(lang, '')) FROM lost) AS ok
  FROM lost LEFT JOIN tail ON lost.lang IS NOT DISTINCT FROM tail.lang AND lost.rule = tail.rule AND lost.step = tail.step),
best AS (SELECT lang, rule, min(cutoff) AS cutoff FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, rule ORDER BY step) AS safe FROM seq)
  WHERE safe GROUP BY 1, 2),
cuts AS (SELECT lang, {cuts} FROM best GROUP BY 1),
q AS (SELECT m.*, NOT base_failed AND NOT ({over}) AS kept FROM m LEFT JOIN cuts ON m.lang IS NOT DISTINCT FROM cuts.lang)"""


@add(
    "op1_quality_rules",
    f"WITH {kept_sql()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q",
)
def op1_quality_rules(spark, d):
    out = quality.quality_rules(table(spark, d, "documents"), table(spark, d, "labels"))
    m = [F.col(f"measures.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")]
    return out.select("doc_id", *m, "kept")


@add(
    "op3_ngram_join",
    f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{licenses.UPPER}', '{licenses.LOWER}'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.root AS component_id FROM w LEFT JOIN n USING (doc_id)
JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) m USING (doc_id)""",
)
def op3_ngram_join(spark, d):
    return ngram_join.jaccard_components(table(spark, d, "documents"))


@add("op10_fingerprint")
def op10_fingerprint(spark, d):
    return fingerprint.fingerprints_and_classes(table(spark, d, "documents"))


@add("op6_line_chunks")
def op6_line_chunks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    clean = line_chunks.remove_repeated_lines(docs, into="removed")
    removed = F.coalesce("removed", F.array().cast("array<struct<first_line:int,n_lines:int,kept_id:bigint>>"))
    return clean.select(
        "doc_id",
        F.size(removed).cast("long").alias("n_removed_chunks"),
        F.aggregate(removed, F.lit(0), lambda n, r: n + r["n_lines"]).cast("long").alias("n_removed_lines"),
        F.transform(removed, lambda r: r["kept_id"]).alias("kept_doc_ids"),
        F.transform(removed, lambda r: r["first_line"]).alias("first_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"),
    )


@add("op2_paragraphs")
def op2_paragraphs(spark, d):
    return paragraphs.repeats(table(spark, d, "documents")).withColumnsRenamed({"id": "doc_id", "kept_id": "kept_doc_id"})


@add("op8_packing")
def op8_packing(spark, d):
    return packing.pack(table(spark, d, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


@add("op9_sentencepiece")
def op9_sentencepiece(spark, d):
    return pieces.encode_documents(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@add("op7_toxicity")
def op7_toxicity(spark, d):
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


@add(
    "op4_warc",
    """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS b, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN b >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS first FROM p)
SELECT page_id, b::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
)
def op4_warc(spark, d):
    root = warc.new_root(spark)
    manifest = warc.write_archives(table(spark, d, "pages"), root)
    return warc.read_archives(manifest, root, with_payload=False).drop("url")


def licenses_sql() -> str:
    """The same scan: both cuts looked up, the rules applied one after another."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in licenses.known_sentences().items())
    lower = f"translate({{}}, '{licenses.UPPER}', '{licenses.LOWER}')"
    norm = "trim(regexp_replace({}, '[^a-z0-9]+', ' ', 'g'))".format(lower.format("s"))
    phrases = ", ".join(f"CASE WHEN contains(k, {quoted(words)}) THEN {quoted(name)} END" for words, name in licenses.PHRASES.items())
    steps, at = [], "r0"
    for i, rule in enumerate(licenses.RULES, 1):
        p = quoted(licenses.pattern(rule))
        steps.append(
            f"r{i} AS (SELECT doc_id, cut, seq, replace(lft, {p}, '|') AS lft, "
            f"CASE WHEN contains(lft, {p}) THEN list_append(ls, '{rule.license}') ELSE ls END AS ls FROM {at})"
        )
        at = f"r{i}"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
known(s, id) AS (VALUES {known}),
cuts AS (SELECT doc_id, 'a' AS cut, string_split(regexp_replace(t, '([.;:!?])[ \t\r\n]+', '\1' || chr(1), 'g'), chr(1)) AS ss FROM d
  UNION ALL SELECT doc_id, 'b', string_split(t, chr(10)) FROM d),
s AS (SELECT doc_id, cut, unnest(ss) AS s, unnest(range(len(ss))) AS i FROM cuts),
n AS (SELECT doc_id, cut, i, coalesce(id, {phrases}) AS id, k AS low FROM (SELECT doc_id, cut, i, {norm} AS k FROM s) AS s LEFT JOIN known ON known.s = k),
r0 AS (SELECT doc_id, cut, string_agg('<' || id || '>', '' ORDER BY i) AS seq, seq AS lft, []::VARCHAR[] AS ls FROM n WHERE id IS NOT NULL GROUP BY 1, 2),
{", ".join(steps)},
l AS (SELECT doc_id, list_sort(list_distinct(flatten(list(ls)))) AS ls FROM {at} GROUP BY 1),
c AS (SELECT doc_id, cut, seq, length(seq) - length(replace(seq, '<', '')) AS n FROM r0),
u AS (SELECT doc_id, count(*) AS n_unknown FROM n WHERE cut = 'b' AND id IS NULL AND regexp_matches(low, '{licenses.HINT}') GROUP BY 1)
SELECT d.doc_id, CASE WHEN coalesce(a.n, 0) >= coalesce(b.n, 0) THEN coalesce(a.seq, '') ELSE b.seq END AS sequence,
 coalesce(array_to_string(l.ls, ','), '') AS licenses, greatest(coalesce(a.n, 0), coalesce(b.n, 0))::BIGINT AS n_known, coalesce(n_unknown, 0)::BIGINT AS n_unknown
FROM d LEFT JOIN c a ON a.doc_id = d.doc_id AND a.cut = 'a' LEFT JOIN c b ON b.doc_id = d.doc_id AND b.cut = 'b'
LEFT JOIN l ON l.doc_id = d.doc_id LEFT JOIN u ON u.doc_id = d.doc_id"""


@add("op5_licenses", licenses_sql())
def op5_licenses(spark, d):
    return licenses.license_scan(table(spark, d, "documents"))


#: crc32 of the text behind each row of ``coded`` (id, hx: its bytes in hex), ending in ``crc`` (id, h).
CRC_SQL = """
crc_bits(b, i, c) AS (SELECT b, 0, b FROM range(256) t(b) UNION ALL
  SELECT b, i + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_bits WHERE i < 8),
crc_step AS (SELECT b, c AS s FROM crc_bits WHERE i = 8),
crc_walk(id, hx, p, c) AS (SELECT id, hx, 1, 4294967295::BIGINT FROM coded UNION ALL
  SELECT id, hx, p + 2, xor(c >> 8, s) FROM crc_walk JOIN crc_step
  ON b = xor(c & 255, 16 * (instr('0123456789ABCDEF', hx[p]) - 1) + instr('0123456789ABCDEF', hx[p + 1]) - 1) WHERE p < length(hx)),
crc AS (SELECT id, xor(c, 4294967295) AS h FROM crc_walk WHERE p > length(hx))"""


@add(
    "op13_spelling",
    f"""WITH RECURSIVE runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}'),
  '[a-z\\x{{C0}}-\\x{{FF}}]{{7,}}')) AS run FROM documents),
found AS (SELECT row_number() OVER () AS id, * FROM (SELECT doc_id, run, count(*) AS k FROM runs GROUP BY 1, 2)),
coded AS (SELECT id, hex(encode(concat(doc_id, ':', run))) AS hx FROM found),
{CRC_SQL},
slip AS (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
  FROM found JOIN crc USING (id)),
words AS (SELECT word, sum(k)::BIGINT AS n FROM slip WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
place AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words),
gap AS (SELECT word, left(word, i - 1) || chr(1) || substr(word, i + 1) AS key FROM place),
less AS (SELECT DISTINCT word, left(word, i - 1) || substr(word, i + 1) AS short FROM place),
near AS (SELECT a.word, b.word AS other FROM gap a JOIN gap b ON a.key = b.key AND a.word <> b.word
  UNION ALL SELECT less.word, short FROM less JOIN words ON words.word = short
  UNION ALL SELECT short, less.word FROM less JOIN words ON words.word = short),
judged AS (SELECT near.word, other, w.n AS m, row_number() OVER (PARTITION BY near.word ORDER BY w.n DESC, other) AS rn,
  count(*) OVER (PARTITION BY near.word) AS n_near FROM near JOIN words w ON w.word = other),
best AS (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM words LEFT JOIN judged ON judged.word = words.word AND rn = 1),
walk(word, here) AS (SELECT word, word FROM best UNION ALL SELECT walk.word, form FROM walk JOIN best ON best.word = here WHERE form IS NOT NULL)
SELECT best.word, form, here AS root, n, n_near, form_n FROM best JOIN walk ON walk.word = best.word
JOIN (SELECT word FROM best WHERE form IS NULL) ends ON ends.word = here""",
)
def op13_spelling(spark, d):
    return spelling.spelling_variants(table(spark, d, "documents"))


@add(
    "op11_collocations",
    f"""WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}') AS t FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS ws FROM (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM d)),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY 1),
g AS (SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM (SELECT lang, ws, unnest([1, 2, 3, 4, 5]) AS k FROM w) WHERE len(ws) >= k),
f AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS ws, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, a, cut, x.f AS l, y.f AS r, n, ((1000::HUGEINT * a * n) // (x.f::HUGEINT * y.f))::BIGINT AS score FROM c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.ws[:cut], ' ') JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.ws[cut + 1:], ' ')
  JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
e AS (SELECT lang, f, string_split(phrase, ' ') AS ws, k, unnest(range(2, k)) AS m FROM f WHERE k > 2),
inner_phrases AS (SELECT lang, f, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM e)),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_phrases GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN longer USING (lang, phrase) WHERE coalesce(100 * most < 100 * a, true))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept QUALIFY rank <= 2000""",
)
def op11_collocations(spark, d):
    return collocations.collocations(table(spark, d, "documents"))


@add("op12_lattice")
def op12_lattice(spark, d):
    return lattice.lattice_scores(table(spark, d, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
