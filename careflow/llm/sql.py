"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from careflow.llm import divergence as d


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _divergence() -> str:
    classes = {
        "lower": r"[^\p{Ll}]", "upper": r"[^\p{Lu}]", "digit": r"[^\p{N}]", "space": r"[^\x20\x09-\x0D]",
        "punctuation": r"[^.,;:!?\x22\x27()\-]", "symbol": r"[^#*$%&|<>]", "letters": r"[^\p{L}]",
    }
    counts = {k: f"length(regexp_replace(text, '{v}', '', 'g'))" for k, v in classes.items()}
    known = " + ".join(counts[k] for k in ("digit", "space", "punctuation", "symbol", "letters"))
    histogram = (
        f"[{counts['lower']}, {counts['upper']}, {counts['letters']} - {counts['lower']} - {counts['upper']},"
        f" {counts['digit']}, {counts['space']}, {counts['punctuation']}, {counts['symbol']}, length(text) - ({known})]"
    )
    lists = ", ".join(f"({_quoted(k)}, [{', '.join(map(_quoted, v))}])" for k, v in d.COMMON_WORDS.items())
    distance = """
      (SELECT CASE WHEN list_sum({a}) > 0 AND list_sum({b}) > 0 THEN sqrt(greatest(0, (
        SELECT sum((CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END
                  + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END) / 2)
        FROM (SELECT unnest({a}) / list_sum({a}) AS p, unnest({b}) / list_sum({b}) AS q)))) END)"""
    reference = """{name} AS (
  SELECT lang, (SELECT list(s ORDER BY i) FROM (SELECT i, sum(c) AS s FROM (
      SELECT unnest(classes) AS c, generate_subscripts(classes, 1) AS i FROM {rows} g WHERE g.lang = k.lang) GROUP BY i)) AS ref_classes,
    (SELECT list(s ORDER BY i) FROM (SELECT i, sum(c) AS s FROM (
      SELECT unnest(common) AS c, generate_subscripts(common, 1) AS i FROM {rows} g WHERE g.lang = k.lang) GROUP BY i)) AS ref_common
  FROM (SELECT DISTINCT lang FROM {rows}) k)"""
    return f"""
WITH lists(lang, listed) AS (VALUES {lists}),
base AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(l.lang, '') AS lang, listed,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM documents LEFT JOIN lists l USING (lang)),
grams AS (
  SELECT doc_id, text, i, list_slice(words, i, i + {d.WINDOW - 1}) AS gram
  FROM (SELECT *, unnest(range(1, len(words) - {d.WINDOW - 2})) AS i FROM base)),
repeats AS (
  SELECT doc_id, count(DISTINCT w) AS n FROM (
    SELECT doc_id, unnest(range(i, i + {d.WINDOW})) AS w FROM (
      SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS times FROM grams) WHERE times > 1)
  GROUP BY doc_id),
counted AS (
  SELECT base.doc_id, lang, len(words) AS n_words, len(text) - {counts['space']} AS word_chars,
    {counts['symbol']} AS n_symbols,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))
      - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
    coalesce(repeats.n, 0) AS n_repeat_words, {histogram} AS classes,
    CASE WHEN listed IS NULL THEN [] ELSE list_append(
      list_transform(listed, lambda c: len(list_filter(plain, lambda w: w = c))),
      len(list_filter(plain, lambda w: NOT list_contains(listed, w)))) END AS common
  FROM (SELECT *, list_transform(words, lambda w: trim(lower(w), {_quoted(d.AROUND)})) AS plain FROM base) base
  LEFT JOIN repeats ON base.doc_id = repeats.doc_id),
judged AS (SELECT *, n_words < {d.MIN_WORDS} OR 100 * n_repeat_words > {d.MAX_REPEATED_PERCENT} * n_words AS base_failed FROM counted),
good AS (SELECT * FROM judged WHERE NOT base_failed AND list_sum(classes) >= {d.MIN_CLASS_CHARS} AND n_words >= {d.MIN_COMMON_WORDS}),
{reference.format(name='ref1', rows='good')},
near1 AS (SELECT good.*, {distance.format(a='classes', b='ref_classes')} AS cd FROM good JOIN ref1 USING (lang)),
near AS (SELECT * FROM near1 JOIN (SELECT lang, avg(cd) AS mean FROM near1 GROUP BY lang) USING (lang) WHERE cd <= mean),
{reference.format(name='ref', rows='near')},
far AS (
  SELECT judged.*, ref_classes, ref_common, {distance.format(a='classes', b='ref_classes')} AS cd, {distance.format(a='common', b='ref_common')} AS wd
  FROM judged LEFT JOIN ref USING (lang))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed
    AND NOT coalesce(list_sum(classes) >= {d.MIN_CLASS_CHARS} AND list_sum(ref_classes) >= {d.MIN_REFERENCE} AND cd > {d.MAX_CLASS_DISTANCE}, false)
    AND NOT coalesce(n_words >= {d.MIN_COMMON_WORDS} AND list_sum(ref_common) >= {d.MIN_REFERENCE} AND wd > {d.MAX_WORD_DISTANCE}, false) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance
FROM far"""


DIVERGENCE = _divergence()


CONTAMINATION = r"""
WITH sep AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
low AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
split AS (SELECT kind, id, regexp_extract_all(t, p) AS w FROM low, sep),
win AS (
  SELECT DISTINCT id, list_slice(w, i, i + 9) AS gram FROM (
    SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM split WHERE kind = 1 AND len(w) > 0)),
lens AS (SELECT DISTINCT len(gram) AS l FROM win),
place AS (
  SELECT id, i, l, list_slice(w, i, i + l - 1) AS gram FROM (
    SELECT id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM split, lens WHERE kind = 0 AND len(w) >= l)),
hit AS (SELECT place.id, i, l, win.id AS item FROM place JOIN win USING (gram)),
n AS (SELECT id, count(DISTINCT pos) AS n_hit FROM (SELECT id, unnest(range(i, i + l)) AS pos FROM hit) GROUP BY id),
it AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
       FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hit) GROUP BY id)
SELECT split.id AS doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM split LEFT JOIN n ON split.id = n.id LEFT JOIN it ON split.id = it.id WHERE kind = 0"""


JACCARD = r"""
WITH RECURSIVE low AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS s FROM (
    SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM low WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM low UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a)
SELECT low.doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM low LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""

VECTORS = """
WITH RECURSIVE given AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
v AS (SELECT vec_id, e FROM given WHERE len([x FOR x IN e IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN e IF x <> 0]) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND CASE WHEN len(a.e) = len(b.e) THEN list_cosine_similarity(a.e, b.e) >= 0.95 END),
reach AS (SELECT vec_id AS a, vec_id AS b FROM given UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM given JOIN least USING (vec_id) LEFT JOIN n USING (vec_id)"""
