"""Queries on keys, markers, names and glossaries.

The tables hold Latin text, so these queries spell its letters, digits and marks in
Arabic script first (``scribe``, the same in SQL): every fold then meets its letters.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import constants as K
from folioscope.functions import textnorm as N
from folioscope.functions import tokens as T
from folioscope.operators import gates, reference
from folioscope.sources.io import table

from .registry import key_sql, registry, words_sql

QUERIES, ORACLES, query = registry()

LATIN = "abcdefghijklmnopqrstuvwxyz0123456789"
SCRIBE = "أبةدَفئهىجکلمنؤٱقرستُوعـيء٠١٢٣٤٥٦٧٨٩"


def scribe(text):
    return F.translate(F.lower(F.coalesce(text, F.lit(""))), LATIN, SCRIBE)


def scribe_sql(text: str = "text") -> str:
    return f"translate(lower(coalesce({text}, '')), '{LATIN}', '{SCRIBE}')"


def folded_sql(text: str) -> str:
    """Marks dropped, letters and digits unified."""
    return f"translate(translate(regexp_replace({text}, '{K.DIACRITICS}', '', 'g'), '{K.LETTERS_FROM}', '{K.LETTERS_TO}'), '{K.DIGITS_FROM}', '{K.DIGITS_TO}')"


def loose_sql(text: str) -> str:
    return rf"trim(regexp_replace({folded_sql(text)}, '\s+', ' ', 'g'))"


def search_sql(text: str) -> str:
    plain = rf"regexp_replace({folded_sql(text)}, '[^\p{{L}}\p{{N}}\s]', ' ', 'g')"
    vocative = rf"regexp_replace({plain}, '(^|\s)ياا', '\1يا ا', 'g')"
    return rf"trim(regexp_replace(replace({vocative}, '{K.HAMZA}', ''), '\s+', ' ', 'g'))"


def tokens_sql(text: str) -> str:
    return rf"list_filter(regexp_split_to_array({text}, '\s+'), lambda x: x <> '')"


@query(rf"""
WITH s AS (SELECT doc_id, {scribe_sql()} AS t FROM documents), k AS (SELECT *, {search_sql('t')} AS search, {loose_sql('t')} AS loose FROM s)
SELECT doc_id, md5(regexp_replace(t, '{K.DIACRITICS}', '', 'g')) AS bare, md5(translate(t, '{K.DIGITS_FROM}', '{K.DIGITS_TO}')) AS digits, md5(translate(t, '{K.LETTERS_FROM}', '{K.LETTERS_TO}')) AS letters,
  md5(search) AS search_key, md5(loose) AS loose_key, md5(regexp_replace(search, '\s+', '', 'g')) AS letters_key, length(search) AS search_chars,
  CASE WHEN len(regexp_extract_all(t, '\p{{L}}')) > 0 THEN round(len(regexp_extract_all(t, '[ء-ي]')) / len(regexp_extract_all(t, '\p{{L}}'))::DOUBLE, 6) ELSE 1.0 END AS arabic_share
FROM k""")
def norm_levels(spark, d):
    """Every step of the keys, and the keys of the search and the loose level."""
    t = scribe(F.col("text"))
    md5 = lambda c: F.md5(c.cast("binary"))
    search, loose = N.normalize(t, "search", stable=True), N.normalize(t, "cer_loose", stable=True)
    return table(spark, d, "documents").select(
        "doc_id", md5(N.strip_diacritics(t)).alias("bare"), md5(N.ascii_digits(t)).alias("digits"), md5(N.unify_letters(t)).alias("letters"), md5(search).alias("search_key"), md5(loose).alias("loose_key"),
        md5(N.letters_key(t, stable=True)).alias("letters_key"), F.length(search).cast("long").alias("search_chars"), F.round(N.arabic_ratio(t), 6).alias("arabic_share"),
    )


#: Some punctuation is followed by a number in brackets, as the tables' own are longer than a marker's.
MARKED_SQL = r"regexp_replace(text, '([a-z])([.,;])', '\1\2 (' || (length(text) % 97) || ') ', 'g')"


def marked(text):
    number = F.concat(F.lit("$1$2 ("), (F.length(text) % 97).cast("string"), F.lit(") "))
    return F.regexp_replace(text, F.lit("([a-z])([.,;])"), number)


@query(rf"""
WITH m AS (SELECT item_id, {MARKED_SQL} AS t FROM benchmark),
g AS (SELECT item_id, t, regexp_extract_all(t, '(\(\s*[0-9]{{1,2}}\s*\))', 1) AS raw, regexp_split_to_array(t, '\(\s*[0-9]{{1,2}}\s*\)') AS gaps FROM m),
r AS (SELECT item_id, raw, gaps, unnest(range(1, len(raw) + 1)) AS i FROM g)
SELECT item_id, raw[i] AS raw, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(raw[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS at,
  CASE WHEN ltrim(regexp_extract(raw[i], '[0-9]+'), '0') = '' THEN '0' ELSE ltrim(regexp_extract(raw[i], '[0-9]+'), '0') END AS marker, CAST(regexp_extract(raw[i], '[0-9]+') AS BIGINT) AS number FROM r""")
def marker_places(spark, d):
    """Each marker of a passage with its offset, its bare form and its number."""
    rows = table(spark, d, "benchmark").select("item_id", F.explode(T.marker_positions(marked(F.col("text")))).alias("m"))
    return rows.select("item_id", "m.raw", F.col("m.at").cast("long").alias("at"), N.normalize_marker(F.col("m.raw")).alias("marker"), T.marker_number(F.col("m.raw")).cast("long").alias("number"))


@query(rf"""
WITH m AS (SELECT item_id, '(' || (item_id % 9 + 1) || ') ' || {MARKED_SQL} AS t FROM benchmark),
p AS (SELECT item_id, t, list_filter(string_split(regexp_replace(t, '(\(\s*[0-9]{{1,2}}\s*\))', chr(1) || '\1', 'g'), chr(1)), lambda x: trim(x) <> '') AS parts FROM m),
s AS (SELECT item_id, CASE WHEN len(parts) > 1 THEN list_transform(parts, lambda x: trim(x)) ELSE [t] END AS parts FROM p)
SELECT item_id, CAST(i - 1 AS BIGINT) AS sub, parts[i] AS part, CASE WHEN regexp_extract(parts[i], '^\s*(\(\s*[0-9]{{1,2}}\s*\))', 1) <> '' THEN CAST(CAST(regexp_extract(regexp_extract(parts[i], '^\s*(\(\s*[0-9]{{1,2}}\s*\))', 1), '[0-9]+') AS BIGINT) AS VARCHAR) END AS marker
FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM s)""")
def note_parts(spark, d):
    """Notes printed as one, split at their markers; each part with the marker it begins with."""
    blocks = table(spark, d, "benchmark").select("item_id", F.concat(F.lit("("), (F.col("item_id") % 9 + 1).cast("string"), F.lit(") "), marked(F.col("text"))).alias("text"))
    rows = T.split_note_rows(blocks)
    return rows.select("item_id", F.col("sub").cast("long").alias("sub"), F.col("text").alias("part"), T.leading_marker(F.lit(None).cast("string"), F.col("text")).alias("marker"))


_SPANNED = r"""'x "' || array_to_string(string_split(text, ' ')[3:6], ' ') || '" y “' || array_to_string(string_split(text, ' ')[8:8], ' ') || '” {' || array_to_string(string_split(text, ' ')[2:4], ' ') || ' } ﴿ ' || array_to_string(string_split(text, ' ')[1:2], ' ') || '﴾ P1, Q' || (item_id % 5) || ' T2' """


@query(rf"""
WITH s AS (SELECT item_id, {_SPANNED} AS t FROM benchmark),
q AS (SELECT item_id, t, list_filter(list_transform(regexp_extract_all(t, '[«"“]([^»"”]{{4,200}})[»"”]', 1), lambda x: {search_sql('x')}), lambda k: len(string_split(k, ' ')) >= 2) AS phrases,
  list_transform(regexp_extract_all(t, '[﴿{{]([^﴿﴾{{}}]+)[﴾}}]', 1), lambda x: trim(x)) AS spans, regexp_extract_all(t, '[PQT][0-9]+') AS tags FROM s)
SELECT item_id, array_to_string(phrases, '|') AS phrases, array_to_string(spans, '|') AS spans, array_to_string(tags, '|') AS tags FROM q""")
def quoted_spans(spark, d):
    """Quoted phrases of two words or more, bracketed spans and source tags."""
    w = F.split("text", " ")
    cut = lambda a, n: F.array_join(F.slice(w, a, n), " ")
    t = F.concat(F.lit('x "'), cut(3, 4), F.lit('" y “'), cut(8, 1), F.lit("” {"), cut(2, 3), F.lit(" } ﴿ "), cut(1, 2), F.lit("﴾ P1, Q"), (F.col("item_id") % 5).cast("string"), F.lit(" T2 "))
    rows = table(spark, d, "benchmark").select("item_id", t.alias("t"))
    return rows.select("item_id", *[F.array_join(f(F.col("t")), "|").alias(n) for n, f in (("phrases", T.quoted_phrases), ("spans", T.bracketed), ("tags", T.source_tags))])


_REPORT = f"""'وعن ' || array_to_string(list_transform(string_split(text, ' ')[1:item_id % 4 + 1], lambda x: {scribe_sql('x')}), ' ') || ' بن ' || {scribe_sql("string_split(text, ' ')[5]")} || ' رضي الله عنه قال نعم ' ||
  CASE item_id % 5 WHEN 0 THEN 'رواه البُخاري' WHEN 1 THEN 'متفقٌ عليه' WHEN 2 THEN 'أخرجه مسلم' WHEN 3 THEN 'رواه البخاري ومسلم' ELSE 'رواه أحمد' END"""


def report(text, item):
    w = F.split(text, " ")
    names = F.array_join(F.transform(F.slice(w, F.lit(1), (item % 4 + 1).cast("int")), scribe), " ")
    source = F.element_at(F.array(*map(F.lit, ("رواه البُخاري", "متفقٌ عليه", "أخرجه مسلم", "رواه البخاري ومسلم", "رواه أحمد"))), (item % 5 + 1).cast("int"))
    return F.concat(F.lit("وعن "), names, F.lit(" بن "), scribe(w[4]), F.lit(" رضي الله عنه قال نعم "), source)


_STOP = ", ".join(f"'{w}'" for w in K.NAME_STOP)


@query(rf"""
WITH r AS (SELECT item_id, {_REPORT} AS t FROM benchmark WHERE len(string_split(text, ' ')) >= 5),
a AS (SELECT *, {loose_sql('t')} AS loose, nullif(regexp_extract(t, '{K.ATTRIBUTION}', 1), '') AS printed FROM r),
n AS (SELECT *, nullif(trim(regexp_extract(loose, '{K.NARRATOR}', 1)), '') AS narrator, coalesce({loose_sql('printed')}, '') AS key FROM a),
w AS (SELECT *, list_distinct(list_filter({tokens_sql(search_sql("coalesce(narrator, '')"))}, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS name FROM n)
SELECT item_id, narrator, array_to_string(list_sort(name), ' ') AS name, printed,
  CASE WHEN printed IS NULL THEN 'unknown' WHEN contains(key, '{K.AGREED}') OR contains(key, '{K.FIRST_BOOK}') OR contains(key, '{K.SECOND_BOOK}') OR contains(key, '{K.BOTH_AUTHORS}') THEN 'in_sahihayn' ELSE 'other' END AS kind,
  CASE WHEN contains(key, '{K.AGREED}') THEN 'agreed' WHEN (contains(key, '{K.FIRST_BOOK}') AND contains(key, '{K.SECOND_BOOK}')) OR contains(key, '{K.BOTH_AUTHORS}') THEN 'both' WHEN contains(key, '{K.FIRST_BOOK}') THEN 'first' ELSE 'second' END AS label FROM w""")
def narrators(spark, d):
    """Narrator, the words of the name that tell persons apart, and the printed attribution with its class and label."""
    rows = table(spark, d, "benchmark").where(F.size(F.split("text", " ")) >= 5).select("item_id", report(F.col("text"), F.col("item_id")).alias("t"))
    who, printed = T.narrator(F.col("t"), stable=True), T.attribution(F.col("t"))
    return rows.select("item_id", who.alias("narrator"), F.array_join(F.array_sort(T.name_tokens(F.coalesce(who, F.lit("")), stable=True)), " ").alias("name"), printed.alias("printed"), gates.attribution_class(printed, stable=True).alias("kind"), gates.attribution_label(printed, stable=True).alias("label"))


@query(rf"""
WITH r AS (SELECT item_id, {_REPORT} AS t FROM benchmark WHERE len(string_split(text, ' ')) >= 5),
n AS (SELECT item_id, list_distinct(list_filter({tokens_sql(search_sql(f"coalesce(regexp_extract({loose_sql('t')}, '{K.NARRATOR}', 1), '')"))}, lambda x: length(x) > 1 AND x NOT IN ({_STOP}))) AS name FROM r)
SELECT a.item_id AS a, b.item_id AS b, CASE WHEN len(a.name) > 0 AND len(b.name) > 0 THEN CASE WHEN len(a.name) <= len(b.name) THEN len(list_filter(a.name, lambda x: NOT list_contains(b.name, x))) = 0 ELSE len(list_filter(b.name, lambda x: NOT list_contains(a.name, x))) = 0 END END AS same
FROM n a JOIN n b ON b.item_id = a.item_id + 1""")
def same_narrators(spark, d):
    """Is each report's narrator the next one's?"""
    rows = table(spark, d, "benchmark").where(F.size(F.split("text", " ")) >= 5).select("item_id", report(F.col("text"), F.col("item_id")).alias("t"))
    names = rows.select("item_id", T.name_tokens(F.coalesce(T.narrator(F.col("t"), stable=True), F.lit("")), stable=True).alias("name"))
    a, b = names.select(F.col("item_id").alias("a"), F.col("name").alias("na")), names.select(F.col("item_id").alias("b"), (F.col("item_id") - 1).alias("a"), F.col("name").alias("nb"))
    return a.join(b, "a").select("a", "b", gates.same_person(F.col("na"), F.col("nb")).alias("same"))


_COMMON = ", ".join(f"'{w}'" for w in dict.fromkeys(K.COMMON_WORDS))


#: Free numbers before a comma, of both scripts, in the middle of a text and at its end.
_NUMBERED = "concat('قال رسول الله 5, ', CASE item_id % 3 WHEN 0 THEN '٥ ' WHEN 1 THEN 'x7y 12. ' ELSE '3-4 ' END, {}, ' ١٢')"
_FREE = r"(^|[^\p{L}\p{N}_])\p{Nd}+($|[^\p{L}\p{N}_])"


@query(rf"""
WITH t AS (SELECT item_id, {_NUMBERED.format(scribe_sql(MARKED_SQL))} AS t FROM benchmark),
m AS (SELECT item_id, regexp_replace(t, '{K.LONG_MARKER}', ' ', 'g') AS t FROM t),
b AS (SELECT item_id, ' ' || regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '{_FREE}', '\1 \2', 'g'), '{_FREE}', '\1 \2', 'g'), '{K.DIACRITICS}', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g') || ' ' AS t FROM m),
w AS (SELECT item_id, {tokens_sql("replace(replace(t, ' مالم ', ' ما لم '), ' مالا يعني ', ' ما لا يعني ')")} AS w FROM b),
f AS (SELECT list({search_sql('c')}) AS formulas FROM unnest([{_COMMON}]) AS u(c)),
k AS (SELECT item_id, w, list_position(list_transform(w, lambda x: length({search_sql('x')}) > 2 AND NOT list_contains(formulas, {search_sql('x')})), true) AS first FROM w, f)
SELECT item_id, array_to_string(CASE WHEN len(w[greatest(coalesce(first, 0), 1) : greatest(coalesce(first, 0), 1) + 5]) >= 4 THEN w[greatest(coalesce(first, 0), 1) : greatest(coalesce(first, 0), 1) + 5] ELSE w[greatest(len(w) - 5, 1) : len(w)] END, ' ') AS phrase FROM k""")
def search_phrases(spark, d):
    """Six words of a report from its first telling word."""
    i = F.col("item_id") % 3
    t = F.concat(F.lit("قال رسول الله 5, "), F.when(i == 0, "٥ ").when(i == 1, "x7y 12. ").otherwise("3-4 "), scribe(marked(F.col("text"))), F.lit(" ١٢"))
    return table(spark, d, "benchmark").select("item_id", T.search_phrase(t, stable=True).alias("phrase"))


_SPOKEN = rf"regexp_replace(regexp_replace({scribe_sql()}, '{K.DIACRITICS}', '', 'g'), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')"


@query(rf"""
WITH w AS (SELECT item_id, {tokens_sql(_SPOKEN)} AS w FROM benchmark),
f AS (SELECT list({search_sql('c')}) AS formulas FROM unnest([{_COMMON}]) AS u(c)),
k AS (SELECT item_id, w, list_position(list_transform(w, lambda x: length({search_sql('x')}) > 2 AND NOT list_contains(formulas, {search_sql('x')})), true) AS first FROM w, f),
p AS (SELECT item_id, CASE WHEN len(w[greatest(coalesce(first, 0), 1) : greatest(coalesce(first, 0), 1) + 5]) >= 4 THEN w[greatest(coalesce(first, 0), 1) : greatest(coalesce(first, 0), 1) + 5] ELSE w[greatest(len(w) - 5, 1) : len(w)] END AS p FROM k)
SELECT item_id, 'https://example.org/search?q=' || replace(url_encode(array_to_string(p, ' ')), '+', '%20') AS url FROM p""")
def search_urls(spark, d):
    """The address that searches for a passage's phrase, spelt in Arabic script."""
    return table(spark, d, "benchmark").select("item_id", T.search_url(scribe(F.col("text")), "https://example.org/search?q=", stable=True).alias("url"))


@query(rf"""
WITH b AS (SELECT item_id, {scribe_sql()} AS t, {tokens_sql(search_sql(scribe_sql()))} AS k FROM benchmark),
q AS (SELECT item_id, t, [k[2], k[4], right(k[3], 3)] AS terms FROM b WHERE len(k) >= 4 AND length(k[3]) >= 3),
g AS (SELECT item_id, terms, regexp_extract_all(t, '\S+') AS w, regexp_split_to_array(t, '\S+') AS gaps FROM q),
r AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM g),
m AS (SELECT item_id, terms, w[i] AS word, {search_sql('w[i]')} AS key, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(w[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS first FROM r)
SELECT item_id, first, first + length(word) AS last FROM m WHERE key <> '' AND len(list_filter(terms, lambda t: key = t OR (length(t) >= 3 AND ends_with(key, t)))) > 0""")
def highlights(spark, d):
    """Spans of the words that meet a passage's second and fourth word, or end like its third."""
    rows = table(spark, d, "benchmark").select("item_id", scribe(F.col("text")).alias("t")).withColumn("k", T.words(N.normalize(F.col("t"), stable=True))).where((F.size("k") >= 4) & (F.length(F.col("k")[2]) >= 3))
    terms = F.array(F.col("k")[1], F.col("k")[3], F.right(F.col("k")[2], F.lit(3)))
    return rows.select("item_id", F.explode(T.highlight_spans(F.col("t"), terms)).alias("s")).select("item_id", F.col("s")[0].cast("long").alias("first"), F.col("s")[1].cast("long").alias("last"))


_FUNCTION = ", ".join(f"'{w}'" for w in K.FUNCTION_WORDS)


def content_sql(text: str) -> str:
    bare = "lambda x: CASE WHEN length(x) > 2 AND left(x, 1) IN ('و', 'ف') THEN substr(x, 2) ELSE x END"
    return f"list_sort(list_filter(list_transform(list_transform({tokens_sql(text)}, lambda x: {search_sql('x')}), {bare}), lambda x: x <> '' AND x NOT IN ({_FUNCTION})))"


@query(rf"SELECT item_id, array_to_string({content_sql(scribe_sql())}, ' ') AS content FROM benchmark")
def content_keys(spark, d):
    """Meaning-bearing words of each passage, sorted."""
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.content_words(scribe(F.col("text"))), " ").alias("content"))


@query(r"""
WITH e AS (SELECT conv_id, turn, coalesce(text, '') || CASE turn % 3 WHEN 0 THEN ' (3)' WHEN 1 THEN '' ELSE ' no' END AS t FROM conversations),
b AS (SELECT conv_id, turn, t, rtrim(regexp_replace(rtrim(t), '(\s*\(\s*[0-9]{1,3}\s*\))+\s*$', '')) AS bare FROM e)
SELECT conv_id, turn, regexp_matches(bare, '[.؟!»:؛*]$') AS ended, rtrim(t) <> '' AND NOT regexp_matches(bare, '[.؟!»:؛*]$') AS cut FROM b""")
def sentence_ends(spark, d):
    """Does a turn end with a sentence, markers aside, or is it cut inside one?"""
    t = F.concat(F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " (3)").when(F.col("turn") % 3 == 1, "").otherwise(" no"))
    return table(spark, d, "conversations").select("conv_id", "turn", T.ends_sentence(F.rtrim(t)).alias("ended"), T.cut_mid(t).alias("cut"))


@query(r"""
SELECT page_id, i - 1 AS pos, ws[i] AS word FROM (SELECT page_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT page_id, list_filter(regexp_split_to_array(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\s+'), lambda x: x <> '') AS ws FROM pages))""")
def page_tokens(spark, d):
    """Every word of a page's text with its place."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", " ").alias("text"))
    return T.token_rows(rows).select("page_id", F.col("pos").cast("long").alias("pos"), "word")


@query(rf"""
WITH s AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '[(\[{{][^)\]}}]{{0,3}}[)\]}}]'), lambda x: trim(x) <> '') AS parts FROM (SELECT conv_id, turn, regexp_replace(text, '([a-z])([.,;])', '\1\2 (' || (length(text) % 97) || ') ', 'g') AS text FROM conversations))
SELECT conv_id, turn, len(parts) AS n, list_max(list_transform(parts, lambda x: length(x))) AS longest FROM s WHERE parts IS NOT NULL""")
def line_parts(spark, d):
    """Parts of a line between short groups in brackets."""
    parts = T.line_segments(marked(F.col("text")))
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(parts).cast("long").alias("n"), F.array_max(F.transform(parts, F.length)).cast("long").alias("longest"))


#: Every tenth passage's second and third word are a term.
_TERMS = f"(SELECT item_id AS pos, 'term' || item_id AS term, array_to_string(w[2:3], ' ') AS key, 'e' || item_id AS equivalent, repeat('x', CAST(item_id % 50 * 40 AS INTEGER)) AS explanation FROM (SELECT item_id, {words_sql()} AS w FROM benchmark) WHERE len(w) >= 3)"


def glossary(spark, d):
    w = T.words(N.latin_key(F.col("text")))
    rows = table(spark, d, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 3)
    return rows.select(F.col("item_id").alias("pos"), F.concat(F.lit("term"), F.col("item_id").cast("string")).alias("term"), F.array_join(F.slice("w", 2, 2), " ").alias("key"), F.concat(F.lit("e"), F.col("item_id").cast("string")).alias("equivalent"), F.repeat(F.lit("x"), (F.col("item_id") % 50 * 40).cast("int")).alias("explanation"))


@query(f"""
WITH g AS {_TERMS}, q AS (SELECT doc_id AS qid, {key_sql()} AS key FROM documents WHERE doc_id % 3 = 0 OR regexp_matches(lower(coalesce(text, '')), 'translat|ترجم')),
h AS (SELECT qid, pos, term, equivalent FROM q JOIN g ON contains(' ' || q.key || ' ', ' ' || g.key || ' '))
SELECT qid, arg_min(term, pos) AS term, arg_min(equivalent, pos) AS equivalent FROM h GROUP BY 1""")
def glossary_terms(spark, d):
    """The first term of the dictionary that a text asking for one has as whole words."""
    asks = F.when(F.col("doc_id") % 3 == 0, "Translate this: ").otherwise("")
    questions = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.concat(asks, F.coalesce("text", F.lit(""))).alias("question"), N.latin_key(F.col("text")).alias("key"))
    return reference.glossary_request(questions, glossary(spark, d), intent="(?i)translat|ترجم")


@query(f"""
WITH g AS (SELECT pos, term, string_split(key, ' ')[1] AS word, substr(explanation, 1, 900) AS explanation FROM {_TERMS}),
t AS (SELECT item_id AS id, unnest(list_distinct({words_sql()})) AS word FROM benchmark),
h AS (SELECT DISTINCT id, pos, term, explanation FROM t JOIN g USING (word))
SELECT id, CAST(place AS BIGINT) AS place, term, length(explanation) AS n_chars FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS place FROM h) WHERE place <= 3""")
def glossary_entries(spark, d):
    """Up to three terms whose word a passage has, with explanations cut at 900 characters."""
    words = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), T.words(N.latin_key(F.col("text"))).alias("words"))
    terms = glossary(spark, d).withColumn("key", F.split("key", " ")[0])
    return reference.term_entries(words, terms).select("id", F.col("place").cast("long").alias("place"), "term", F.length("explanation").cast("long").alias("n_chars"))
