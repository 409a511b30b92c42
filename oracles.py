"""SQL the queries are checked against. Written by hand for a second engine, apart from the library."""

SQL = {}

# ------------------------------------------------------------------ text pieces

WS = (
    r"[\s\x{000b}\x{001c}-\x{001f}\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}"
    r"\x{202f}\x{205f}\x{3000}]"
)


def strip(x):
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def norm(x):
    spaced = f"regexp_replace(lower({strip(f'coalesce({x}, {chr(39)*2})')}), '{WS}+', ' ', 'g')"
    return rf"regexp_replace({spaced}, '[^\p{{L}}\p{{N}}_ \-.,()]', '', 'g')"


def has_units(x):
    low = f"lower(coalesce({x}, ''))"
    words = "mm|cm|m|in|inch|ft|kg|g|lb|oz|v|a|w|hz|°c|°f"
    return (
        rf"(regexp_matches({low}, '\p{{Nd}}+{WS}*({words})')"
        rf" OR regexp_matches({low}, '\p{{Nd}}+{WS}*[a-z]{{1,3}}({WS}|$|,|\))'))"
    )


def has_numbers(x):
    return rf"regexp_matches(coalesce({x}, ''), '\p{{Nd}}')"


def words(x):
    return f"list_filter(regexp_split_to_array({x}, ' +'), lambda t: t <> '')"


RAW = """
  SELECT p_partkey AS row_id,
    CASE WHEN p_partkey % 5 = 0 THEN NULL WHEN p_partkey % 7 = 0 THEN '  ' ELSE concat(' ', p_type) END AS c,
    CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE p_brand END AS s,
    CASE WHEN p_partkey % 20 = 0 THEN '' ELSE 'Name ' END AS a,
    CASE WHEN p_partkey % 3 = 0 THEN concat(chr(9), upper(p_name), ' ± ', p_size, ' °C,')
         WHEN p_partkey % 11 = 0 THEN NULL ELSE concat(p_name, ' /  ', p_size, 'kΩ') END AS v
  FROM part"""
CLEANED = f"""
  SELECT row_id, {strip("coalesce(c, '')")} AS category, {strip("coalesce(s, '')")} AS sub_category,
    {strip("coalesce(a, '')")} AS attribute_name, {strip("coalesce(v, '')")} AS preset_value
  FROM ({RAW})
  WHERE NOT (c IS NULL AND s IS NULL AND a IS NULL AND v IS NULL)
    AND NOT (coalesce(c, '') = '' AND coalesce(s, '') = '' AND coalesce(a, '') = '')"""
COMPUTED = f"""{norm('preset_value')} AS normalized,
  category || '|' || sub_category || '|' || attribute_name AS composite_key,
  {has_units('preset_value')} AS has_units, {has_numbers('preset_value')} AS has_numbers,
  contains(preset_value, ',') AS has_commas"""

SQL["clean_reference"] = CLEANED
SQL["computed_columns"] = f"SELECT row_id, {COMPUTED} FROM ({CLEANED})"
SQL["normalize_values"] = f"""
  SELECT doc_id, md5(n) AS digest, length(n) AS length
  FROM (SELECT doc_id, {norm('text')} AS n FROM documents)"""
SQL["value_flags"] = f"""
  SELECT conv_id, turn, {has_units('text')} AS has_units, {has_numbers('text')} AS has_numbers,
    contains(text, ',') AS has_commas FROM conversations"""
SQL["row_positions"] = "SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) - 1 AS row_id FROM customer"
SQL["display_cut"] = """
  SELECT doc_id, CASE WHEN length(text) > 100 THEN left(text, 100) || '...' ELSE text END AS text, lang
  FROM documents"""
SQL["validation_report"] = f"""
  SELECT n = 0 AS ok, CASE WHEN n > 0 THEN concat('Found ', n, ' rows with empty values in key columns')
    ELSE 'Data validation passed' END AS message
  FROM (SELECT count(*) FILTER (c IS NULL OR s IS NULL OR a IS NULL) AS n FROM ({RAW}))"""

# ------------------------------------------------------------------ derived tables

BAND = "CASE WHEN p_size <= 25 THEN 'Small' ELSE 'Big' END"
W1, W2 = "split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"
REFERENCE = f"""
  SELECT 2 * p_partkey AS row_id, p_type AS category, {BAND} AS sub_category,
    'Name' AS attribute_name, p_name AS preset_value FROM part
  UNION ALL
  SELECT 2 * p_partkey + 1, p_type, {BAND}, 'Size', concat(p_size, 'mm') FROM part"""
INPUTS = f"""
  SELECT 3 * p_partkey AS input_id, p_type AS category, {BAND} AS sub_category,
    'Name' AS attribute_name,
    CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name)
      WHEN 2 THEN replace(p_name, ' ', ', ') ELSE left(p_name, length(p_name) - 1) END AS input_value
  FROM part
  UNION ALL
  SELECT 3 * p_partkey + 1, p_type, {BAND}, 'Size', concat(p_size, ' MM') FROM part
  UNION ALL
  SELECT 3 * p_partkey + 2, p_type, {BAND}, 'Label',
    CASE p_partkey % 4 WHEN 0 THEN concat({W2}, ' ', {W1}) WHEN 1 THEN concat({W2}, '-', {W1})
      WHEN 2 THEN concat(p_name, ' ', p_brand) ELSE concat(left({W1}, 3), ' ', {W2}) END
  FROM part
  UNION ALL
  SELECT -1 - s_suppkey, 'SUPPLIER', concat('N', s_nationkey), 'Name', s_name FROM supplier"""
PAIRS = f"""
  SELECT p_partkey, a, b FROM (SELECT p_partkey, concat(p_name, ' ', p_size, 'mm') AS a,
    CASE p_partkey % 5 WHEN 0 THEN concat(p_name, ', ', p_size, ' mm')
      WHEN 1 THEN concat({W2}, ' ', {W1}, ' ', p_size + 1, 'cm')
      WHEN 2 THEN concat(p_name, '-', lower(p_type)) WHEN 3 THEN concat(lower(p_type), ' ', p_name, '.')
      ELSE concat(p_size * 2, '.5 v ', {W1}) END AS b FROM part)
  UNION ALL
  SELECT p.p_partkey, concat(p.p_name, ' ', p.p_size, 'mm'), concat(q.p_name, ' ', q.p_size, 'mm')
  FROM part p JOIN part q ON q.p_partkey = p.p_partkey + 1"""
SQL["alias_inputs"] = f"SELECT input_id, category, sub_category, attribute_name, input_value FROM ({INPUTS})"
SQL["positional_inputs"] = SQL["alias_inputs"]
SQL["positional_three"] = f"""
  SELECT input_id, category, sub_category, attribute_name, CASE WHEN compat THEN category ELSE '' END AS input_value, compat
  FROM ({INPUTS}), (VALUES (false), (true)) AS t(compat)"""
SQL["structure_report"] = f"""
  SELECT 'reference' AS shape, '' AS reference_lacks, 'input_value' AS inputs_lack, true AS is_reference, false AS is_input,
    (SELECT count(*) FROM ({REFERENCE})) AS n_rows
  UNION ALL SELECT 'inputs', 'preset_value', '', false, true, (SELECT count(*) FROM ({INPUTS}))
  UNION ALL SELECT 'accounts', '', 'input_value', true, false, (SELECT count(*) FROM customer)
  UNION ALL SELECT 'raw', 'category,sub_category,attribute_name,preset_value', 'category,sub_category,attribute_name,input_value', false, false,
    (SELECT count(*) FROM part)
  UNION ALL SELECT 'keyless', 'sub_category,preset_value', 'sub_category,input_value', false, false, (SELECT count(*) FROM ({INPUTS}))"""
SQL["blank_inputs"] = f"""
  SELECT input_id, category, sub_category, attribute_name, input_value FROM ({INPUTS})
  WHERE input_id % 5 NOT IN (0, 1, 2) AND trim(input_value) <> ''"""
SQL["computed_if_absent"] = f"""
  SELECT row_id, category, sub_category, attribute_name, preset_value, upper(preset_value) AS normalized, false AS has_units,
    concat_ws('|', category, sub_category, attribute_name) AS composite_key, {has_numbers('preset_value')} AS has_numbers,
    contains(preset_value, ',') AS has_commas FROM ({REFERENCE})"""

# ------------------------------------------------------------------ pair scores


def scores(pairs, extra=""):
    """CTEs from ``pairs(a, b)`` (distinct) to ``scored`` with one column per score."""
    return f"""
  todo_words AS (SELECT a, b, {words('a')} AS wa, {words('b')} AS wb FROM ({pairs})),
  sets AS (SELECT *,
      list_sort(list_distinct(wa)) AS da0, list_sort(list_distinct(wb)) AS db0 FROM todo_words),
  parts AS (SELECT a, b, array_to_string(list_sort(wa), ' ') AS sa, array_to_string(list_sort(wb), ' ') AS sb,
      len(wa) AS na, len(wb) AS nb,
      array_to_string(list_filter(da0, lambda t: list_contains(db0, t)), ' ') AS i,
      array_to_string(list_filter(da0, lambda t: NOT list_contains(db0, t)), ' ') AS da,
      array_to_string(list_filter(db0, lambda t: NOT list_contains(da0, t)), ' ') AS db FROM sets),
  forms AS (SELECT *, trim(i || ' ' || da) AS ia, trim(i || ' ' || db) AS ib,
      CASE WHEN length(a) <= length(b) THEN a ELSE b END AS short,
      CASE WHEN length(a) <= length(b) THEN b ELSE a END AS long FROM parts),
  windows AS (
    SELECT a, b, n AS x, substr(t, p, length(n)) AS y FROM (
      SELECT a, b, n, t, unnest(range(1, length(t) + 1)) AS p FROM (
        SELECT a, b, short AS n, long AS t FROM forms
        UNION SELECT a, b, long, short FROM forms WHERE length(short) = length(long)))
    UNION
    SELECT a, b, n, substr(t, 1, k) FROM (
      SELECT a, b, n, t, unnest(range(1, length(n))) AS k FROM (
        SELECT a, b, short AS n, long AS t FROM forms
        UNION SELECT a, b, long, short FROM forms WHERE length(short) = length(long)))),
  wanted AS (
    SELECT a AS x, b AS y FROM forms UNION SELECT sa, sb FROM forms UNION SELECT ia, ib FROM forms
    UNION SELECT i, ia FROM forms UNION SELECT i, ib FROM forms UNION SELECT x, y FROM windows),
  lcs AS MATERIALIZED (SELECT x, y, CASE WHEN x = '' AND y = '' THEN 100.0 WHEN x = '' OR y = '' THEN 0.0
    ELSE 200.0 * (length(x) - bit_count(list_reduce(list_prepend((1::BIGINT << length(x)) - 1,
        list_transform(string_split(y, ''), lambda c: list_sum(list_transform(range(length(x)),
          lambda q: CASE WHEN x[q + 1] = c THEN 1::BIGINT << q ELSE 0::BIGINT END))::BIGINT)),
        lambda v, m: ((v + (v & m)) | (v - (v & m))) & ((1::BIGINT << length(x)) - 1))))
      / (length(x) + length(y)) END AS r FROM wanted),
  best_window AS (SELECT a, b, max(r) AS r FROM windows JOIN lcs USING (x, y) GROUP BY a, b),
  base AS (SELECT f.*, l1.r AS ratio,
      CASE WHEN a = '' AND b = '' THEN 100.0 WHEN a = '' OR b = '' THEN 0.0 ELSE w.r END AS partial_ratio,
      l2.r AS token_sort_ratio,
      CASE WHEN na = 0 OR nb = 0 THEN 0.0 WHEN i <> '' AND (da = '' OR db = '') THEN 100.0
        WHEN i <> '' THEN greatest(l3.r, l4.r, l5.r) ELSE l3.r END AS token_set_ratio
    FROM forms f JOIN lcs l1 ON l1.x = f.a AND l1.y = f.b
    JOIN lcs l2 ON l2.x = f.sa AND l2.y = f.sb JOIN lcs l3 ON l3.x = f.ia AND l3.y = f.ib
    JOIN lcs l4 ON l4.x = f.i AND l4.y = f.ia JOIN lcs l5 ON l5.x = f.i AND l5.y = f.ib
    LEFT JOIN best_window w USING (a, b)),
  figures AS (SELECT *, regexp_extract_all(a, '[0-9]+\\.?[0-9]*')::DOUBLE[] AS fa,
      regexp_extract_all(b, '[0-9]+\\.?[0-9]*')::DOUBLE[] AS fb,
      regexp_replace(a, '[^0-9.]', '', 'g') = regexp_replace(b, '[^0-9.]', '', 'g') AS same_digits FROM base),
  tests AS (SELECT *, len(fa) = len(fb) AND coalesce(list_bool_and(list_transform(list_zip(fa, fb),
      lambda z: CASE WHEN z[2] = 0 THEN false ELSE z[1] / z[2] BETWEEN 0.1 AND 10 END)), true) AS converts,
      regexp_replace(lower(a), '[^a-z0-9_ ]', '', 'g') = regexp_replace(lower(b), '[^a-z0-9_ ]', '', 'g') AS same_words
    FROM figures),
  scored AS (SELECT *, least(100, 30 * converts::INT + 20 * (lower(a) = lower(b))::INT + 15 * same_words::INT
        + 25 * same_digits::INT)::DOUBLE AS pattern,
      least(100, 30 * (converts AND len(fa) > 0)::INT + 20 * (lower(a) = lower(b))::INT + 15 * same_words::INT
        + 25 * (same_digits AND len(fa) > 0 AND len(fb) > 0)::INT)::DOUBLE AS guarded,
      100 * jaro_winkler_similarity(a, b) AS jaro_winkler,
      (1 - levenshtein(a, b) / greatest(length(a), length(b))) * 100 AS levenshtein FROM tests),
  ranked AS (SELECT *, greatest(ratio, partial_ratio, token_sort_ratio, token_set_ratio, pattern) AS best,
      greatest(ratio, partial_ratio, token_sort_ratio, token_set_ratio, round(jaro_winkler, 9), levenshtein, guarded) AS best_full
    FROM scored),
  named AS (SELECT *, CASE best WHEN ratio THEN 'ratio' WHEN partial_ratio THEN 'partial_ratio'
      WHEN token_sort_ratio THEN 'token_sort_ratio' WHEN token_set_ratio THEN 'token_set_ratio' ELSE 'pattern' END AS kind,
      CASE best_full WHEN ratio THEN 'ratio' WHEN partial_ratio THEN 'partial_ratio'
      WHEN token_sort_ratio THEN 'token_sort_ratio' WHEN token_set_ratio THEN 'token_set_ratio'
      WHEN round(jaro_winkler, 9) THEN 'jaro_winkler' WHEN levenshtein THEN 'levenshtein' ELSE 'pattern' END AS kind_full
    FROM ranked)"""


def comment(score, kind):
    return f"""concat('similar ', round_even({score}, 0)::BIGINT, '%', CASE {kind}
      WHEN 'ratio' THEN ' | overall similarity' WHEN 'partial_ratio' THEN ' | partial match'
      WHEN 'token_sort_ratio' THEN ' | reordered words' WHEN 'pattern' THEN ' | pattern match' ELSE '' END)"""


_PAIRED = f"pairs AS MATERIALIZED ({PAIRS}), d AS (SELECT DISTINCT a, b FROM pairs)"
# words, sorted words, shared and own words of both sides
_WORDS = f"""
  tw AS (SELECT a, b, {words('a')} AS wa, {words('b')} AS wb FROM d),
  ts AS (SELECT *, list_sort(list_distinct(wa)) AS ua, list_sort(list_distinct(wb)) AS ub,
    array_to_string(list_sort(wa), ' ') AS sa, array_to_string(list_sort(wb), ' ') AS sb FROM tw),
  tp AS (SELECT *, array_to_string(list_filter(ua, lambda t: list_contains(ub, t)), ' ') AS i,
    array_to_string(list_filter(ua, lambda t: NOT list_contains(ub, t)), ' ') AS da,
    array_to_string(list_filter(ub, lambda t: NOT list_contains(ua, t)), ' ') AS db FROM ts),
  w AS (SELECT *, trim(i || ' ' || da) AS ia, trim(i || ' ' || db) AS ib FROM tp)"""


def lcs_table(wanted, name="lcs"):
    """``name(x, y, r)`` for the pairs of ``wanted(x, y)``: the bits of each character of x are laid out once."""
    full = "((1::BIGINT << length(x)) - 1)"
    step = f"((v + (v & m)) | (v - (v & m))) & {full}"
    bits = "list_sum(list_transform(range(length(x)), lambda q: CASE WHEN x[q + 1] = c THEN 1::BIGINT << q ELSE 0::BIGINT END))::BIGINT"
    return f"""
  {name}_x AS MATERIALIZED (SELECT x, list_distinct(string_split(x, '')) AS cs,
    list_transform(list_distinct(string_split(x, '')), lambda c: {bits}) AS ms FROM (SELECT DISTINCT x FROM ({wanted}) WHERE x <> '')),
  {name} AS MATERIALIZED (SELECT x, y, CASE WHEN x = '' AND y = '' THEN 100.0 WHEN x = '' OR y = '' THEN 0.0
    ELSE 200.0 * (length(x) - bit_count(list_reduce(list_prepend({full}, list_transform(string_split(y, ''),
      lambda c: coalesce(ms[list_position(cs, c)], 0))), lambda v, m: {step}))) / (length(x) + length(y)) END AS r
    FROM (SELECT DISTINCT x, y FROM ({wanted})) LEFT JOIN {name}_x USING (x))"""


_FIGURES = """
  fg AS (SELECT *, regexp_extract_all(a, '[0-9]+\\.?[0-9]*')::DOUBLE[] AS fa, regexp_extract_all(b, '[0-9]+\\.?[0-9]*')::DOUBLE[] AS fb,
    regexp_replace(a, '[^0-9.]', '', 'g') = regexp_replace(b, '[^0-9.]', '', 'g') AS same_digits,
    regexp_replace(lower(a), '[^\\p{L}\\p{N}_ ]', '', 'g') = regexp_replace(lower(b), '[^\\p{L}\\p{N}_ ]', '', 'g') AS same_words FROM d),
  tf AS (SELECT *, len(fa) = len(fb) AND coalesce(list_bool_and(list_transform(list_zip(fa, fb),
    lambda z: CASE WHEN z[2] = 0 THEN false ELSE z[1] / z[2] BETWEEN 0.1 AND 10 END)), true) AS converts FROM fg),
  pattern AS (SELECT a, b, converts, same_words, same_digits,
    least(100, 30 * converts::INT + 20 * (lower(a) = lower(b))::INT + 15 * same_words::INT + 25 * same_digits::INT)::DOUBLE AS pattern,
    least(100, 30 * (converts AND len(fa) > 0)::INT + 20 * (lower(a) = lower(b))::INT + 15 * same_words::INT
      + 25 * (same_digits AND len(fa) > 0 AND len(fb) > 0)::INT)::DOUBLE AS guarded FROM tf)"""
# each score as CTEs that end in a table of its name with (a, b, <name>)
_SCORES = {
    "ratio": f"{lcs_table('SELECT a AS x, b AS y FROM d', 'l1')}, ratio AS (SELECT x AS a, y AS b, r AS ratio FROM l1)",
    "token_sort_ratio": f"""{lcs_table('SELECT sa AS x, sb AS y FROM w', 'l2')},
  token_sort_ratio AS (SELECT a, b, r AS token_sort_ratio FROM w JOIN l2 ON x = sa AND y = sb)""",
    "token_set_ratio": f"""{lcs_table('SELECT ia AS x, ib AS y FROM w UNION ALL SELECT i, ia FROM w UNION ALL SELECT i, ib FROM w', 'l3')},
  token_set_ratio AS (SELECT a, b, CASE WHEN len(wa) = 0 OR len(wb) = 0 THEN 0.0 WHEN i <> '' AND (da = '' OR db = '') THEN 100.0
      WHEN i <> '' THEN greatest(p.r, q.r, s.r) ELSE p.r END AS token_set_ratio
    FROM w JOIN l3 p ON p.x = ia AND p.y = ib JOIN l3 q ON q.x = i AND q.y = ia JOIN l3 s ON s.x = i AND s.y = ib)""",
    "partial_ratio": f"""
  fits AS (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS n, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS t FROM d
    UNION SELECT a, b, b, a FROM d WHERE length(a) = length(b)),
  spots AS (SELECT a, b, n, substr(t, p, length(n)) AS y FROM (SELECT *, unnest(range(1, length(t) + 1)) AS p FROM fits)
    UNION SELECT a, b, n, left(t, k) FROM (SELECT *, unnest(range(1, length(n))) AS k FROM fits)),
  {lcs_table('SELECT n AS x, y FROM spots', 'l4')},
  partial_ratio AS (SELECT d.a, d.b, CASE WHEN d.a = '' AND d.b = '' THEN 100.0 WHEN d.a = '' OR d.b = '' THEN 0.0 ELSE m.r END AS partial_ratio
    FROM d LEFT JOIN (SELECT a, b, max(r) AS r FROM spots JOIN l4 ON x = n AND l4.y = spots.y GROUP BY a, b) m USING (a, b))""",
    "edits": """
  edits AS (SELECT a, b, 100 * jaro_winkler_similarity(a, b) AS jaro_winkler,
    (1 - levenshtein(a, b) / greatest(length(a), length(b))) * 100 AS levenshtein FROM d)""",
    "pattern": _FIGURES,
}


def pair_sql(select, *names):
    """``select`` over all pairs with the named scores joined on; nothing else is computed."""
    needs_words = any(n.startswith("token") for n in names) or "w" in names
    parts = [_PAIRED, *([_WORDS] if needs_words else []), *(_SCORES[n] for n in names if n != "w")]
    joins = "".join(f" JOIN {n} USING (a, b)" for n in names)
    return f"WITH {', '.join(parts)} SELECT p_partkey, a, b, {select} FROM pairs{joins}"


for _name in ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "pattern"):
    SQL[f"score_pairs_{_name}"] = pair_sql(f"round({_name}, 6) AS score", _name)
for _name in ("jaro_winkler", "levenshtein"):
    SQL[f"score_pairs_{_name}"] = pair_sql(f"round({_name}, 6) AS score", "edits")
_OBSERVED = ("ratio", "partial_ratio", "token_sort_ratio", "token_set_ratio", "pattern")
_BEST = f"greatest({', '.join(_OBSERVED)})"
_KIND = f"CASE {_BEST} " + " ".join(f"WHEN {n} THEN '{n}'" for n in _OBSERVED) + " END"
SQL["score_pairs_best"] = pair_sql(
    f"""round({_BEST}, 6) AS score, {_KIND} AS match_type, {comment(_BEST, _KIND)} AS comment,
    format('{{:.1f}}%', round_even({_BEST}, 6)) AS shown""", *_OBSERVED)
SQL["score_pairs_native"] = pair_sql("round(levenshtein, 6) AS levenshtein, pattern, sa AS sorted_a", "edits", "pattern", "w")
SQL["weighted_score"] = pair_sql("""round((0.9 * ratio + 0.8 * partial_ratio + 0.85 * token_sort_ratio + 0.8 * token_set_ratio
    + 0.75 * jaro_winkler + 0.7 * levenshtein + 0.6 * guarded) / 5.4, 6) AS score""", *_OBSERVED, "edits")
SQL["explain_match"] = pair_sql(f"""CASE {_KIND} WHEN 'ratio' THEN 'High overall similarity'
      WHEN 'partial_ratio' THEN 'Contains similar substring'
      WHEN 'token_sort_ratio' THEN 'Similar words in different order'
      WHEN 'token_set_ratio' THEN 'Similar word set'
      WHEN 'pattern' THEN 'Pattern-based match (format/unit differences)' END
    || CASE WHEN lower(a) = lower(b) THEN ' (case difference)' WHEN same_words THEN ' (punctuation difference)'
      WHEN converts THEN ' (unit conversion)' WHEN same_digits THEN ' (number format difference)' ELSE '' END AS note""", *_OBSERVED)
SQL["score_conversation_turns"] = r"""
  WITH own AS (SELECT string_agg(DISTINCT c, '') AS chars FROM (SELECT unnest(string_split(lower(text), '')) AS c FROM conversations)
    WHERE ord(c) > 127),
  t AS (SELECT x.conv_id, x.turn, lower(x.text) AS a, lower(y.text) AS b,
      -- the edit distance of this engine counts bytes: capitals, which no longer occur, stand in for longer characters
      translate(lower(x.text), chars, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', length(chars))) AS ta,
      translate(lower(y.text), chars, left('ABCDEFGHIJKLMNOPQRSTUVWXYZ', length(chars))) AS tb
    FROM conversations x JOIN conversations y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1, own),
  f AS (SELECT *, regexp_extract_all(a, '[0-9]+\.?[0-9]*')::DOUBLE[] AS fa, regexp_extract_all(b, '[0-9]+\.?[0-9]*')::DOUBLE[] AS fb FROM t)
  SELECT conv_id, turn, round(CASE WHEN length(a) = 0 AND length(b) = 0 THEN 100.0
      ELSE (1 - levenshtein(coalesce(ta, a), coalesce(tb, b)) / greatest(length(a), length(b))) * 100 END, 6) AS levenshtein,
    least(100, 30 * (len(fa) = len(fb) AND coalesce(list_bool_and(list_transform(list_zip(fa, fb),
        lambda z: CASE WHEN z[2] = 0 THEN false ELSE z[1] / z[2] BETWEEN 0.1 AND 10 END)), true))::INT
      + 20 * (a = b)::INT
      + 15 * (regexp_replace(a, '[^\p{L}\p{N}_\s]', '', 'g') = regexp_replace(b, '[^\p{L}\p{N}_\s]', '', 'g'))::INT
      + 25 * (regexp_replace(a, '[^0-9.]', '', 'g') = regexp_replace(b, '[^0-9.]', '', 'g'))::INT)::DOUBLE AS pattern
  FROM f"""

# ------------------------------------------------------------------ match stages


def cascade(inputs, reference, threshold, k, cross=True, full=False, unmatched=False, form=norm):
    best, kind = ("best_full", "kind_full") if full else ("best", "kind")
    crossing = f"""
      UNION SELECT DISTINCT i.n, r.n FROM (SELECT DISTINCT n FROM open_values) i, (SELECT DISTINCT n FROM refs) r"""
    return f"""
  WITH refs AS MATERIALIZED (SELECT *, {form('preset_value')} AS n FROM ({reference})),
  ins AS MATERIALIZED (SELECT *, {form('input_value')} AS n FROM ({inputs})),
  firsts AS (SELECT category, sub_category, attribute_name, n, min(row_id) AS row_id,
      arg_min(preset_value, row_id) AS preset_value FROM refs GROUP BY ALL),
  exact AS MATERIALIZED (SELECT i.*, f.row_id, f.preset_value FROM ins i
      JOIN firsts f USING (category, sub_category, attribute_name, n)),
  open_values AS MATERIALIZED (SELECT DISTINCT category, sub_category, attribute_name, n FROM ins
      ANTI JOIN firsts USING (category, sub_category, attribute_name, n)),
  {scores(f'''SELECT DISTINCT o.n AS a, r.n AS b FROM open_values o JOIN refs r USING (category, sub_category, attribute_name)
      {crossing if cross else ''}''')},
  hits AS MATERIALIZED (SELECT a, b, {best} AS score, {kind} AS kind FROM named WHERE {best} >= {threshold}),
  in_key AS MATERIALIZED (SELECT o.category, o.sub_category, o.attribute_name, o.n, r.row_id, r.preset_value, h.score, h.kind,
      row_number() OVER (PARTITION BY o.category, o.sub_category, o.attribute_name, o.n ORDER BY h.score DESC, r.row_id) AS place
    FROM open_values o JOIN refs r USING (category, sub_category, attribute_name) JOIN hits h ON h.a = o.n AND h.b = r.n
    QUALIFY place <= {k}),
  still_open AS (SELECT * FROM open_values ANTI JOIN in_key USING (category, sub_category, attribute_name, n)),
  across AS (SELECT o.n, r.row_id, r.preset_value, h.score, h.kind, r.category, r.sub_category, r.attribute_name,
      row_number() OVER (PARTITION BY o.n ORDER BY h.score DESC, r.row_id) AS place
    FROM (SELECT DISTINCT n FROM still_open WHERE {str(cross).lower()}) o JOIN hits h ON h.a = o.n JOIN refs r ON r.n = h.b
    QUALIFY place <= {k}),
  found AS (
    SELECT input_id, 1 AS match_rank, input_value AS original_input, preset_value AS matched_value,
      100.0 AS similarity, 'Exact match found' AS comment, preset_value AS suggested_value, 'Exact Match' AS status,
      category, sub_category, attribute_name, row_id AS preset_row_id, 'exact' AS match_type FROM exact
    UNION ALL
    SELECT i.input_id, m.place, i.input_value, m.preset_value, round(m.score, 6), {comment('m.score', 'm.kind')},
      m.preset_value, 'Similar Match', i.category, i.sub_category, i.attribute_name, m.row_id, m.kind
    FROM ins i JOIN in_key m USING (category, sub_category, attribute_name, n)
    UNION ALL
    SELECT i.input_id, m.place, i.input_value, m.preset_value, round(m.score, 6), 'Cross-category match: ' || m.kind,
      m.preset_value, 'Similar Match', m.category, m.sub_category, m.attribute_name, m.row_id, m.kind
    FROM ins i JOIN still_open o ON o.category = i.category AND o.sub_category = i.sub_category
      AND o.attribute_name = i.attribute_name AND o.n = i.n JOIN across m ON m.n = i.n),
  results AS (SELECT * FROM found {'''UNION ALL
    SELECT input_id, NULL, input_value, NULL, NULL, NULL, NULL, 'Not Found', category, sub_category, attribute_name, NULL, NULL
    FROM ins ANTI JOIN found USING (input_id)''' if unmatched else ''})"""


SQL["exact_match"] = f"""
  WITH refs AS (SELECT *, {norm('preset_value')} AS n FROM ({REFERENCE})),
  firsts AS (SELECT category, sub_category, attribute_name, n, min(row_id) AS row_id FROM refs GROUP BY ALL)
  SELECT i.input_id, i.category, i.sub_category, i.attribute_name, i.input_value,
    r.preset_value AS matched_value, r.row_id AS preset_row_id
  FROM ({INPUTS}) i JOIN firsts f ON f.category = i.category AND f.sub_category = i.sub_category
    AND f.attribute_name = i.attribute_name AND f.n = {norm('i.input_value')}
  JOIN refs r ON r.row_id = f.row_id"""



def _asked(columns):
    return f"""
  WITH refs AS MATERIALIZED (SELECT *, {norm('preset_value')} AS n FROM ({REFERENCE})),
  asked AS MATERIALIZED (SELECT DISTINCT {columns}, {norm('input_value')} AS n FROM ({INPUTS})),"""


_KEY = "category, sub_category, attribute_name"
SQL["fuzzy_in_key"] = f"""{_asked(_KEY)}
  {scores(f'SELECT DISTINCT q.n AS a, r.n AS b FROM asked q JOIN refs r USING ({_KEY})')}
  SELECT q.category, q.sub_category, q.attribute_name, q.n AS normalized, r.row_id AS preset_row_id,
    r.preset_value AS matched_value, round(h.best, 6) AS similarity, h.kind AS match_type,
    row_number() OVER (PARTITION BY q.category, q.sub_category, q.attribute_name, q.n ORDER BY h.best DESC, r.row_id) AS match_rank
  FROM asked q JOIN refs r USING ({_KEY}) JOIN named h ON h.a = q.n AND h.b = r.n
  WHERE h.best >= 75 QUALIFY match_rank <= 5"""
SQL["cross_key"] = f"""{_asked("1 AS one")}
  {scores('SELECT DISTINCT q.n AS a, r.n AS b FROM asked q, (SELECT DISTINCT n FROM refs) r')}
  SELECT h.a AS normalized, r.row_id AS preset_row_id, r.preset_value AS matched_value,
    round(h.best, 6) AS similarity, h.kind AS match_type,
    row_number() OVER (PARTITION BY h.a ORDER BY h.best DESC, r.row_id) AS match_rank
  FROM named h JOIN refs r ON r.n = h.b WHERE h.best >= 75 QUALIFY match_rank <= 5"""

SQL["match_cascade"] = cascade(INPUTS, REFERENCE, 75, 5) + " SELECT * FROM results"
SQL["match_cascade_full"] = cascade(INPUTS, REFERENCE, 85, 3, full=True) + " SELECT * FROM results"
SQL["match_prepared"] = SQL["match_cascade"]
SQL["match_low_threshold"] = cascade(INPUTS, REFERENCE, 55, 3) + " SELECT * FROM results"
def ruled(x):
    """All spelling rules, as far as these values go: sizes in millimetres, else words without punctuation."""
    size = rf"regexp_extract({x}, '^([0-9]+) ?(?i:mm)$', 1)"
    plain = f"""array_to_string({words(rf"regexp_replace({norm(x)}, '[^\p{{L}}\p{{N}}_ ]', ' ', 'g')")}, ' ')"""
    return f"CASE WHEN {size} <> '' THEN concat({size}, ' 0 length') ELSE {plain} END"


def cased(x):
    return norm(x).replace("lower(", "(", 1)


SQL["match_case_kept"] = cascade(INPUTS, REFERENCE, 75, 3, form=cased) + " SELECT * FROM results"
SQL["match_rules"] = cascade(INPUTS, REFERENCE, 75, 3, form=ruled) + " SELECT * FROM results"
SQL["unmatched"] = cascade(INPUTS, REFERENCE, 75, 5, unmatched=True) + """
  SELECT input_id, category, sub_category, attribute_name, original_input, status FROM results WHERE status = 'Not Found'"""
ACCOUNTS = """
  SELECT c_custkey AS row_id, c_mktsegment AS category, concat('N', c_nationkey) AS sub_category,
    'Account' AS attribute_name, c_name AS preset_value FROM customer"""
ACCOUNT_INPUTS = """
  SELECT o_orderkey AS input_id, c_mktsegment AS category, concat('N', c_nationkey) AS sub_category,
    'Account' AS attribute_name, CASE o_orderkey % 3
      WHEN 0 THEN concat('CUSTOMER ', lpad(o_custkey::VARCHAR, 9, '0'))
      WHEN 1 THEN concat('Cust. ', lpad(o_custkey::VARCHAR, 9, '0'))
      ELSE concat('Customer#', lpad(o_custkey::VARCHAR, 9, '0')) END AS input_value
  FROM orders JOIN customer ON c_custkey = o_custkey"""
# Every account has a near value in its key, so the stage across keys has nothing left to ask.
SQL["match_accounts"] = cascade(ACCOUNT_INPUTS, ACCOUNTS, 75, 3, cross=False) + " SELECT * FROM results"


def _vectors(rows, column):
    """(value, slot, weight) of hashed trigrams, scaled to unit length."""
    grams = f"""SELECT DISTINCT v, unnest(range(greatest(length(v), 1))) AS pos, ' ' || lower(v) || ' ' AS t
      FROM (SELECT {column} AS v FROM {rows})"""
    slots = f"""SELECT v, ('0x' || left(md5(substr(t, pos + 1, 3)), 8))::BIGINT % 256 AS slot, count(*) AS n FROM ({grams}) GROUP BY ALL"""
    return f"SELECT v, slot, n / sqrt(sum(n * n) OVER (PARTITION BY v)) AS w FROM ({slots})"


def _semantic(cross):
    return cascade(INPUTS, REFERENCE, 60, 3, cross=cross, unmatched=True) + f""",
  lost AS (SELECT input_id, original_input AS v FROM results WHERE status = 'Not Found'),
  left_vectors AS ({_vectors('lost', 'v')}), right_vectors AS ({_vectors('refs', 'preset_value')}),
  near AS (SELECT l.v, r.v AS p, round(100 * sum(l.w * r.w), 6) AS score FROM left_vectors l JOIN right_vectors r USING (slot) GROUP BY ALL),
  semantic AS (SELECT n.v, r.*, score, row_number() OVER (PARTITION BY n.v ORDER BY score DESC, r.row_id) AS place
    FROM near n JOIN refs r ON r.preset_value = n.p QUALIFY place <= 3)
  SELECT * FROM found UNION ALL
  SELECT input_id, place, lost.v, preset_value, score, 'Semantic similarity match', preset_value, 'Similar Match',
    category, sub_category, attribute_name, row_id, 'semantic'
  FROM lost JOIN semantic s ON s.v = lost.v WHERE score >= 60"""


SQL["match_semantic"], SQL["match_semantic_in_key"] = _semantic(True), _semantic(False)
SQL["semantic_topk"] = """
  SELECT q.vec_id, p.vec_id AS match_id,
    round(100 * list_inner_product(q.embedding::DOUBLE[], p.embedding::DOUBLE[]), 6) AS s,
    row_number() OVER (PARTITION BY q.vec_id ORDER BY s DESC, p.vec_id) AS match_rank
  FROM embeddings q, embeddings p QUALIFY match_rank <= 5"""
SQL["semantic_topk"] = f"SELECT vec_id, match_rank, match_id, round(s, 4) AS similarity FROM ({SQL['semantic_topk']})"

# ------------------------------------------------------------------ reports on results

_R = cascade(INPUTS, REFERENCE, 75, 3, unmatched=True)
SQL["result_summary"] = f"""{_R},
  totals AS (SELECT count(*) AS n, count(*) FILTER (status = 'Exact Match') AS e,
    count(*) FILTER (status = 'Similar Match') AS s, count(*) FILTER (status = 'Not Found') AS f,
    avg(similarity) AS mean, max(similarity) AS top, min(similarity) AS low FROM results)
  SELECT unnest(range(8)) AS position, unnest(['Total Comparisons', 'Exact Matches', 'Similar Matches', 'Not Found',
      'Average Similarity Score', 'Highest Similarity Score', 'Lowest Similarity Score', 'Export Date']) AS metric,
    unnest([n::VARCHAR, e::VARCHAR, s::VARCHAR, f::VARCHAR, format('{{:.2f}}%', mean), format('{{:.2f}}%', top),
      format('{{:.2f}}%', low), '2024-01-01 00:00:00']) AS value FROM totals"""
SQL["status_breakdown"] = f'{_R} SELECT status, count(*) AS "count" FROM results GROUP BY status'
SQL["category_pivot"] = f"""{_R}
  SELECT category, count(*) FILTER (status = 'Exact Match') AS exact, count(*) FILTER (status = 'Similar Match') AS similar,
    count(*) FILTER (status = 'Not Found') AS not_found FROM results GROUP BY category"""
SQL["report_parts"] = f"""
  SELECT 'comparison_results' AS part, coalesce(preset_row_id::VARCHAR, '') AS name, concat_ws('|', original_input, matched_value, comment,
      suggested_value, status, category, sub_category, attribute_name) AS detail, round(similarity, 6) AS score FROM ({_R} SELECT * FROM results)
  UNION ALL SELECT 'summary', metric, value, NULL FROM ({SQL['result_summary']})
  UNION ALL SELECT 'status_breakdown', status, "count"::VARCHAR, NULL FROM ({SQL['status_breakdown']})
  UNION ALL SELECT 'category_analysis', category, concat_ws('|', exact, "similar", not_found), NULL FROM ({SQL['category_pivot']})"""
SQL["score_histogram"] = f"""{_R},
  edge AS (SELECT min(similarity) AS lo, max(similarity) AS hi FROM results),
  bins AS (SELECT unnest(range(20)) AS bin),
  placed AS (SELECT least(floor((similarity - lo) / (hi - lo) * 20), 19)::BIGINT AS bin FROM results, edge WHERE similarity IS NOT NULL)
  SELECT bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_start,
    (SELECT count(*) FROM placed p WHERE p.bin = b.bin) AS "count" FROM bins b, edge"""
SQL["result_filter"] = f"""{_R}
  SELECT input_id, match_rank, similarity, preset_row_id FROM results
  WHERE status = 'Similar Match' AND category = 'PROMO' AND similarity >= 80"""
SQL["result_filter_not_found"] = f"""{_R}
  SELECT input_id, category, original_input FROM results WHERE status = 'Not Found'"""
SQL["filter_choices"] = f"""{_R}
  SELECT DISTINCT 'status' AS field, status AS value FROM results UNION SELECT DISTINCT 'category', category FROM results"""
SQL["worst_categories"] = f"""{_R}
  SELECT category, count(*) AS "count" FROM results WHERE status = 'Not Found' GROUP BY category
  ORDER BY 2 DESC, 1 LIMIT 10"""
SQL["csv_roundtrip"] = f"{_R} SELECT input_id::VARCHAR AS input_id, original_input, comment FROM results"
SQL["top_categories"] = f"""
  SELECT category, count(*) AS "count" FROM ({REFERENCE}) GROUP BY category ORDER BY 2 DESC, 1 LIMIT 20"""
SQL["load_metrics"] = " UNION ALL ".join(
    f"""SELECT count(*) AS records, count(DISTINCT category) AS categories, count(DISTINCT sub_category) AS sub_categories,
    count(DISTINCT attribute_name) AS attributes, '{kind}' AS kind FROM ({rows})"""
    for kind, rows in (("reference", REFERENCE), ("input", INPUTS))
)

# ------------------------------------------------------------------ quality

_CUSTOMER = [
    ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
    ("c_mktsegment", "string"),
]
SQL["quality_report"] = " UNION ALL ".join(
    [
        "SELECT '' AS \"column\", 'total_rows' AS metric, count(*)::VARCHAR AS value FROM customer",
        "SELECT '', 'total_columns', '5'",
        "SELECT '', 'duplicate_rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM customer)))::VARCHAR FROM customer",
    ]
    + [f"SELECT '{c}', 'data_type', '{t}'" for c, t in _CUSTOMER]
    + [f"SELECT '{c}', 'null_count', (count(*) - count({c}))::VARCHAR FROM customer" for c, _ in _CUSTOMER]
    + [
        f"SELECT '{c}', 'null_percentage', format('{{:.1f}}', (count(*) - count({c})) * 100.0 / count(*)) FROM customer"
        for c, t in _CUSTOMER
        if t == "string"
    ]
    + [
        f"SELECT '{c}', 'unique_values', count(DISTINCT {c})::VARCHAR FROM customer"
        for c, t in _CUSTOMER
        if t == "string"
    ]
)
_LABELS = [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")]
SQL["quality_numeric"] = " UNION ALL ".join(
    [
        "SELECT '' AS \"column\", 'total_rows' AS metric, count(*)::VARCHAR AS value FROM labels",
        "SELECT '', 'total_columns', '3'",
        "SELECT '', 'duplicate_rows', (count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM labels)))::VARCHAR FROM labels",
    ]
    + [f"SELECT '{c}', 'data_type', '{t}'" for c, t in _LABELS]
    + [f"SELECT '{c}', 'null_count', (count(*) - count({c}))::VARCHAR FROM labels" for c, _ in _LABELS]
)
SQL["data_summary"] = " UNION ALL ".join(
    [
        "SELECT '' AS \"column\", 'total_records' AS metric, count(*)::VARCHAR AS value FROM documents",
        "SELECT '', 'columns', '5'",
    ]
    + [f"SELECT '{c}', 'unique', count(DISTINCT {c})::VARCHAR FROM documents" for c in ("text", "lang", "source")]
    + [f"SELECT '{c}', 'null', (count(*) - count({c}))::VARCHAR FROM documents" for c in ("text", "lang", "source")]
)
SQL["duplicate_rows"] = """
  SELECT count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang FROM documents)) AS duplicate_rows FROM documents"""


def _frequent(table, columns, n):
    melted = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS value FROM {table}" for c in columns)
    return f"""SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS rank FROM (
      SELECT "column", value, count(*) AS "count" FROM ({melted}) WHERE value IS NOT NULL GROUP BY "column", value)
      QUALIFY rank <= {n}"""


SQL["top_values"] = _frequent("events", ["event_type", "props"], 5)
SQL["most_common"] = f"""SELECT "column", value, "count" FROM ({_frequent('orders', ['o_orderstatus', 'o_orderpriority'], 1)})"""

# ------------------------------------------------------------------ profiles

_ALL_CASES = r"""CASE WHEN regexp_matches(v, '[A-Z]') AND NOT regexp_matches(v, '[a-z]') THEN 'all_uppercase'
    WHEN regexp_matches(v, '[a-z]') AND NOT regexp_matches(v, '[A-Z]') THEN 'all_lowercase'
    WHEN regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '[A-Za-z][A-Z]')
      AND NOT regexp_matches(v, '(^|[^A-Za-z])[a-z]') THEN 'title_case' ELSE 'mixed_case' END"""
_FORMATS = r"""CASE WHEN bool_and(regexp_matches(v, '[0-9]+[a-zA-Z]+')) THEN 'number_unit'
    WHEN bool_and(regexp_matches(v, '[a-zA-Z]+,\s*[0-9]+')) THEN 'text_number'
    WHEN bool_and(regexp_matches(v, '[0-9]') AND NOT regexp_matches(v, '[a-zA-Z]')) THEN 'number_only'
    WHEN bool_and(regexp_matches(v, '[a-zA-Z]') AND NOT regexp_matches(v, '[0-9]')) THEN 'text_only'
    ELSE 'mixed' END"""
_VALUES = f"SELECT {_KEY}, row_id, preset_value AS v FROM ({REFERENCE})"
SQL["typical_format"] = f"SELECT {_KEY}, {_FORMATS} AS typical_format FROM ({_VALUES}) GROUP BY {_KEY}"
_SENSITIVE = f"""SELECT {_KEY}, len(list_distinct(flatten(list([v, lower(v), upper(v)])))) > count(DISTINCT v) AS case_sensitivity
  FROM ({_VALUES}) GROUP BY {_KEY}"""
SQL["key_profile"] = rf"""
  WITH vals AS (SELECT *, regexp_extract_all(v, '[0-9]+\.?[0-9]*') AS nums,
      regexp_extract_all(v, '[0-9]+\s*([a-zA-Z°]+)', 1) AS units,
      regexp_extract_all(v, '[0-9]+\.?[0-9]*\s*([a-zA-Z°]+)', 1) AS combos FROM ({_VALUES}))
  SELECT category, sub_category, attribute_name, count(*) AS n_values, any_value(typical_format) AS typical_format,
    any_value(case_sensitivity) AS case_sensitivity,
    min(list_min(nums::DOUBLE[])) AS min_value, max(list_max(nums::DOUBLE[])) AS max_value,
    array_to_string(list_filter([CASE WHEN bool_or(contains(v, ',')) THEN ',' END, CASE WHEN bool_or(contains(v, ';')) THEN ';' END,
      CASE WHEN bool_or(contains(v, '|')) THEN '|' END, CASE WHEN bool_or(contains(v, ' - ')) THEN ' - ' END,
      CASE WHEN bool_or(contains(v, ' to ')) THEN ' to ' END], lambda x: x IS NOT NULL), '/') AS separators,
    array_to_string(list_sort(list_distinct(flatten(list(units)))), '/') AS common_units,
    array_to_string(list_sort(list_distinct(list_filter(flatten(list(combos)), lambda u: length(u) >= 2))), '/') AS unit_combinations,
    array_to_string(list_sort(list_distinct(list_transform(list_filter(flatten(list(nums)), lambda x: contains(x, '.')),
      lambda x: length(split_part(x, '.', 2))))), '/') AS decimal_places,
    count(*) FILTER ({_ALL_CASES} = 'all_uppercase') AS all_uppercase, count(*) FILTER ({_ALL_CASES} = 'all_lowercase') AS all_lowercase,
    count(*) FILTER ({_ALL_CASES} = 'title_case') AS title_case, count(*) FILTER ({_ALL_CASES} = 'mixed_case') AS mixed_case,
    {', '.join(f"count(*) FILTER (contains(v, '{m}')) AS has_{'' if m.islower() else 'upper_'}{m.lower()}" for m in 'mknupfMKNUPFGTgt')}
  FROM vals JOIN ({SQL['typical_format']}) USING ({_KEY}) JOIN ({_SENSITIVE}) USING ({_KEY})
  GROUP BY {_KEY}"""
SQL["key_units"] = rf"""
  WITH vals AS (SELECT *, regexp_extract_all(v, '[0-9]+\.?[0-9]*') AS nums FROM ({_VALUES})),
  items AS (
    SELECT {_KEY}, 'unit' AS kind, unnest(regexp_extract_all(v, '[0-9]+\s*([a-zA-Z°]+)', 1)) AS item FROM vals
    UNION ALL SELECT {_KEY}, 'combination', unnest(list_filter(regexp_extract_all(v, '[0-9]+\.?[0-9]*\s*([a-zA-Z°]+)', 1), lambda u: length(u) >= 2)) FROM vals
    UNION ALL SELECT {_KEY}, 'decimals', unnest(list_transform(list_filter(nums, lambda x: contains(x, '.')), lambda x: length(split_part(x, '.', 2))::VARCHAR)) FROM vals)
  SELECT *, row_number() OVER (PARTITION BY {_KEY}, kind ORDER BY uses DESC, item) AS place
  FROM (SELECT {_KEY}, kind, item, count(*) AS uses FROM items GROUP BY ALL)"""
_PART = r"([0-9]+\.?[0-9]*)\s*([mknupfMKNUPFGTgt]?)\s*([a-zA-Z°]*)"
SQL["value_parts"] = f"""
  SELECT p_partkey, b, array_to_string(list_transform(regexp_extract_all(b, '{_PART}', 1)::DOUBLE[],
      lambda x: round(x * 10)::BIGINT::VARCHAR), '/') AS numbers,
    array_to_string(regexp_extract_all(b, '{_PART}', 2), '/') AS multipliers,
    array_to_string(regexp_extract_all(b, '{_PART}', 3), '/') AS units
  FROM ({PAIRS})"""
_N = r"[0-9]+\.?[0-9]*"
SQL["smart_normalize"] = rf"""
  WITH learned AS (SELECT * FROM ({SQL['typical_format']}) JOIN ({_SENSITIVE}) USING ({_KEY})),
  known AS (SELECT i.*, typical_format AS f, CASE WHEN case_sensitivity THEN trim(input_value) ELSE lower(trim(input_value)) END AS t,
      regexp_extract(input_value, '{_N}') AS n, regexp_extract(input_value, '[a-zA-Z°]+') AS u,
      trim(regexp_replace(input_value, '{_N}\s*[a-zA-Z°]*', '', 'g')) AS w
    FROM ({INPUTS}) i JOIN learned USING ({_KEY}))
  SELECT input_id, input_value,
    regexp_replace(regexp_replace(regexp_replace(t, '({_N})\s*([mknupfMKNUPFGTgt])\s*([a-zA-Z°]+)', '\1\2\3', 'g'),
      '({_N})\s*([mknupfMKNUPFGTgt])([^a-zA-Z°]|$)', '\1\2\3', 'g'), '\s+', ' ', 'g') AS smart,
    CASE WHEN n = '' THEN input_value WHEN f = 'number_unit' THEN n || upper(u)
      WHEN f = 'text_number' AND w <> '' THEN w || ', ' || n WHEN f IN ('text_number', 'number_only') THEN n
      ELSE input_value END AS formatted FROM known"""

_LETTER = "[mknupfMKNUPFGTgt]"


def _smart(x):
    t = f"CASE WHEN case_sensitivity THEN trim({x}) ELSE lower(trim({x})) END"
    return rf"""regexp_replace(regexp_replace(regexp_replace({t}, '({_N})\s*({_LETTER})\s*([a-zA-Z°]+)', '\1\2\3', 'g'),
      '({_N})\s*({_LETTER})([^a-zA-Z°]|$)', '\1\2\3', 'g'), '\s+', ' ', 'g')"""


def _count(x, pattern):
    return f"len(regexp_extract_all({x}, '{pattern}'))"


def _same(what):
    return what.replace("X", "input_value") + " = " + what.replace("X", "preset_value")


_RUNS = "list_sort(list_distinct(regexp_extract_all(X, '[a-zA-Z°]+')))"
_BOTH = f"({_count('input_value', '[0-9]')} > 0 AND {_count('preset_value', '[0-9]')} > 0)"
_NUMS = f"regexp_extract_all(X, '{_N}')::DOUBLE[]"
_CLOSE = f"""({_count('input_value', _N)} = {_count('preset_value', _N)} AND coalesce(list_bool_and(list_transform(
    list_zip({_NUMS.replace('X', 'input_value')}, {_NUMS.replace('X', 'preset_value')}), lambda z: abs(z[1] - z[2]) <= 0.001)), true))"""
SQL["match_profiled"] = rf"""
  WITH learned AS MATERIALIZED (SELECT * FROM ({SQL['typical_format']}) JOIN ({_SENSITIVE}) USING ({_KEY})),
  refs AS MATERIALIZED (SELECT *, {norm('preset_value')} AS n, {_smart('preset_value')} AS smart FROM ({REFERENCE}) JOIN learned USING ({_KEY})),
  ins AS MATERIALIZED (SELECT *, {norm('input_value')} AS n FROM ({INPUTS})),
  asked AS MATERIALIZED (SELECT *, {_smart('input_value')} AS smart, CASE WHEN num = '' THEN input_value
        WHEN typical_format = 'number_unit' THEN num || upper(run)
        WHEN typical_format = 'text_number' AND rest <> '' THEN rest || ', ' || num
        WHEN typical_format IN ('text_number', 'number_only') THEN num ELSE input_value END AS formatted
    FROM (SELECT DISTINCT {_KEY}, input_value, n, regexp_extract(input_value, '{_N}') AS num,
        regexp_extract(input_value, '[a-zA-Z°]+') AS run,
        trim(regexp_replace(input_value, '{_N}\s*[a-zA-Z°]*', '', 'g')) AS rest FROM ins) LEFT JOIN learned USING ({_KEY})),
  firsts AS (SELECT {_KEY}, smart, min(row_id) AS row_id, arg_min(preset_value, row_id) AS preset_value FROM refs GROUP BY ALL),
  exact AS MATERIALIZED (SELECT {_KEY}, input_value, f.row_id, f.preset_value, 'Exact match found' AS comment
    FROM asked a JOIN firsts f USING ({_KEY}, smart)),
  formatted AS MATERIALIZED (SELECT a.*, {_smart('formatted')} AS again FROM asked a ANTI JOIN exact USING ({_KEY}, input_value)
    WHERE formatted <> input_value),
  second AS MATERIALIZED (SELECT a.category, a.sub_category, a.attribute_name, a.input_value, f.row_id, f.preset_value,
      'Exact match found (formatted from "' || a.input_value || '" to "' || a.formatted || '")' AS comment
    FROM formatted a JOIN firsts f ON f.category = a.category AND f.sub_category = a.sub_category
      AND f.attribute_name = a.attribute_name AND f.smart = a.again),
  open_values AS MATERIALIZED (SELECT * FROM asked ANTI JOIN exact USING ({_KEY}, input_value) ANTI JOIN second USING ({_KEY}, input_value)),
  {scores(f"""SELECT DISTINCT o.smart AS a, r.smart AS b FROM open_values o JOIN refs r USING ({_KEY})
    UNION SELECT o.n, r.n FROM (SELECT DISTINCT n FROM open_values) o, (SELECT DISTINCT n FROM refs) r""")},
  rated AS MATERIALIZED (SELECT q.category, q.sub_category, q.attribute_name, input_value, preset_value, case_sensitivity,
      ratio, partial_ratio, token_sort_ratio, token_set_ratio,
      30 * (CASE WHEN case_sensitivity THEN input_value = preset_value ELSE lower(input_value) = lower(preset_value) END)::INT
        + 25 * ({_same(_RUNS)})::INT + 20 * ({_same(_count('X', _N + chr(92) + 's*' + _LETTER))})::INT
        + 15 * ({_same(_count('X', _N))})::INT AS form,
      {_BOTH}::INT * (40 * ({_same(f"regexp_extract_all(X, '{_PART}', 2)")})::INT
        + 30 * ({_same(f"regexp_extract_all(X, '{_PART}', 3)")})::INT + 30 * {_CLOSE}::INT) AS unit
    FROM (SELECT DISTINCT o.category, o.sub_category, o.attribute_name, o.input_value, r.preset_value, o.smart AS a, r.smart AS b,
        o.case_sensitivity FROM open_values o JOIN refs r USING ({_KEY})) q JOIN named USING (a, b)),
  judged AS MATERIALIZED (SELECT *, greatest(ratio, partial_ratio, token_sort_ratio, token_set_ratio, form, unit)::DOUBLE AS score FROM rated),
  kinds AS MATERIALIZED (SELECT *, CASE score WHEN ratio THEN 'ratio' WHEN partial_ratio THEN 'partial_ratio'
      WHEN token_sort_ratio THEN 'token_sort_ratio' WHEN token_set_ratio THEN 'token_set_ratio' WHEN form THEN 'pattern'
      ELSE 'multiplier_unit' END AS kind FROM judged WHERE score >= 75),
  in_key AS MATERIALIZED (SELECT k.*, r.row_id, row_number() OVER (PARTITION BY {_KEY}, input_value ORDER BY score DESC, row_id) AS place
    FROM kinds k JOIN refs r USING ({_KEY}, preset_value) QUALIFY place <= 3),
  still_open AS (SELECT * FROM open_values ANTI JOIN in_key USING ({_KEY}, input_value)),
  across AS (SELECT o.n, r.row_id, r.preset_value, h.best AS score, h.kind, r.category, r.sub_category, r.attribute_name,
      row_number() OVER (PARTITION BY o.n ORDER BY h.best DESC, r.row_id) AS place
    FROM (SELECT DISTINCT n FROM still_open) o JOIN named h ON h.a = o.n JOIN refs r ON r.n = h.b
    WHERE h.best >= 75 QUALIFY place <= 3)
  SELECT input_id, 1 AS match_rank, input_value AS original_input, preset_value AS matched_value, 100.0::DOUBLE AS similarity, comment,
    preset_value AS suggested_value, 'Exact Match' AS status, {_KEY}, row_id AS preset_row_id, 'exact' AS match_type
  FROM ins JOIN (SELECT * FROM exact UNION ALL SELECT * FROM second) USING ({_KEY}, input_value)
  UNION ALL
  SELECT input_id, place, input_value, preset_value, round(score, 6), concat('similar ', round_even(score, 0)::BIGINT, '%',
      CASE WHEN lower(input_value) = lower(preset_value) THEN CASE WHEN NOT case_sensitivity THEN ' | case normalized'
        WHEN input_value <> preset_value THEN ' | case difference' ELSE '' END ELSE '' END,
      CASE WHEN {_same(f"regexp_extract_all(X, '{_LETTER}')")} THEN '' ELSE ' | multiplier difference' END,
      CASE WHEN {_same(_RUNS)} THEN '' ELSE ' | unit difference' END,
      CASE kind WHEN 'ratio' THEN ' | overall similarity' WHEN 'partial_ratio' THEN ' | partial match'
        WHEN 'token_sort_ratio' THEN ' | reordered words' WHEN 'pattern' THEN ' | pattern match'
        WHEN 'multiplier_unit' THEN ' | multiplier/unit match' ELSE '' END),
    preset_value, 'Similar Match', {_KEY}, row_id, kind FROM ins JOIN in_key USING ({_KEY}, input_value)
  UNION ALL
  SELECT i.input_id, m.place, i.input_value, m.preset_value, round(m.score, 6), 'Cross-category match: ' || m.kind, m.preset_value,
    'Similar Match', m.category, m.sub_category, m.attribute_name, m.row_id, m.kind
  FROM ins i SEMI JOIN still_open USING ({_KEY}, input_value) JOIN across m ON m.n = i.n"""

# ------------------------------------------------------------------ dictionaries

_SIZED = """
  SELECT p_partkey AS row_id, CASE p_partkey % 3 WHEN 0 THEN 'Length' WHEN 1 THEN 'Operating temp' ELSE 'Capacitance or Width' END AS attribute_name,
    CASE p_partkey % 6 WHEN 0 THEN concat(p_size, ' mm') WHEN 3 THEN concat(p_size / 10, 'CM')
      WHEN 1 THEN concat(p_size, ' C max') WHEN 4 THEN concat(p_size * 2, '°F, typ w')
      WHEN 2 THEN concat(p_size, ' f') ELSE concat(p_size, ' kg x ', p_size, ' lb, w') END AS preset_value FROM part"""
_UNITS = """(VALUES ('mm', 'length', 1.0::DOUBLE, 0::DOUBLE), ('cm', 'length', 10, 0), ('m', 'length', 1000, 0), ('in', 'length', 25.4, 0),
  ('inch', 'length', 25.4, 0), ('ft', 'length', 304.8, 0), ('g', 'weight', 1, 0), ('kg', 'weight', 1000, 0),
  ('lb', 'weight', 453.592, 0), ('oz', 'weight', 28.3495, 0), ('v', 'voltage', 1, 0), ('mv', 'voltage', 0.001, 0),
  ('kv', 'voltage', 1000, 0), ('a', 'current', 1, 0), ('ma', 'current', 0.001, 0), ('ua', 'current', 0.000001, 0),
  ('w', 'power', 1, 0), ('mw', 'power', 0.001, 0), ('kw', 'power', 1000, 0), ('hz', 'frequency', 1, 0),
  ('khz', 'frequency', 1e3, 0), ('mhz', 'frequency', 1e6, 0), ('ghz', 'frequency', 1e9, 0), ('c', 'temperature', 1, 0),
  ('f', 'temperature', 5.0::DOUBLE / 9, -160.0::DOUBLE / 9), ('k', 'temperature', 1, -273.15)) AS units(unit, dimension, factor, shift)"""
SQL["unit_normalize"] = rf"""
  WITH found AS (SELECT row_id, preset_value, attribute_name,
      unnest(regexp_extract_all(preset_value, '([0-9]+\.?[0-9]*)\s*(°?[a-zA-Z]+)', 1)) AS number,
      unnest(regexp_extract_all(preset_value, '([0-9]+\.?[0-9]*)\s*(°?[a-zA-Z]+)', 2)) AS word,
      generate_subscripts(regexp_extract_all(preset_value, '([0-9]+\.?[0-9]*)\s*(°?[a-zA-Z]+)', 2), 1) AS nth FROM ({_SIZED})),
  sure AS (SELECT row_id, preset_value, nth, unit, dimension, number::DOUBLE * factor + shift AS x FROM found JOIN {_UNITS} ON unit = replace(lower(word), '°', '')
    WHERE dimension <> 'temperature' OR contains(word, '°') OR contains(lower(attribute_name), 'temp'))
  SELECT row_id, preset_value, row_number() OVER (PARTITION BY row_id ORDER BY nth) - 1 AS place, unit, dimension,
    CASE WHEN x = 0 THEN 0 ELSE round(round(x * pow(10, 5 - floor(log10(abs(x))))) / pow(10, 5 - floor(log10(abs(x)))), 6) END AS base
  FROM sure"""
SQL["unit_match"] = f"""
  WITH asked AS (SELECT p_partkey AS input_id, p_type AS category, {BAND} AS sub_category, 'Size' AS attribute_name,
      concat(round(p_size / 25.4, 4), ' in') AS input_value, round(p_size / 25.4, 4) * 25.4 AS x FROM part),
  known AS (SELECT *, replace(preset_value, 'mm', '')::DOUBLE AS y FROM ({REFERENCE}) WHERE attribute_name = 'Size')
  SELECT input_id, row_number() OVER (PARTITION BY input_id ORDER BY abs(x - y), row_id) AS match_rank,
    input_value, row_id AS preset_row_id, preset_value
  FROM asked JOIN known USING ({_KEY}) WHERE abs(x - y) <= 0.001 * greatest(abs(x), abs(y)) QUALIFY match_rank <= 3"""
_SYNONYMS = """(VALUES ('voltage', 'v'), ('voltage', 'volt'), ('voltage', 'volts'), ('current', 'a'), ('current', 'amp'),
  ('current', 'amps'), ('current', 'ampere'), ('current', 'amperes'), ('power', 'w'), ('power', 'watt'), ('power', 'watts'),
  ('frequency', 'hz'), ('frequency', 'hertz'), ('resistance', 'ohm'), ('resistance', 'ohms'), ('resistance', 'r'),
  ('capacitance', 'f'), ('capacitance', 'farad'), ('capacitance', 'farads'), ('inductance', 'h'), ('inductance', 'henry'),
  ('inductance', 'henries'), ('temperature', 'temp'), ('temperature', '°c'), ('temperature', '°f'), ('temperature', 'celsius'),
  ('temperature', 'fahrenheit'), ('length', 'l'), ('length', 'len'), ('length', 'long'), ('width', 'w'), ('width', 'wide'),
  ('height', 'h'), ('height', 'high'), ('height', 'tall'), ('diameter', 'dia'), ('diameter', 'd'), ('thickness', 'thick'),
  ('thickness', 't')) AS synonyms(kept, word)"""
_TOKENS = f"""SELECT row_id, preset_value, lower(attribute_name) AS topic, unnest({words('lower(preset_value)')}) AS t,
  generate_subscripts({words('lower(preset_value)')}, 1) AS nth FROM ({_SIZED})"""
SQL["synonym_expand"] = f"""
  WITH tokens AS ({_TOKENS}), meanings AS (SELECT word, count(*) AS n FROM {_SYNONYMS} GROUP BY word)
  SELECT row_id, preset_value, string_agg(coalesce(kept, t), ' ' ORDER BY nth) AS expanded FROM tokens
  LEFT JOIN (SELECT * FROM {_SYNONYMS} JOIN meanings USING (word)) s ON s.word = t AND (n = 1 OR contains(topic, kept))
  GROUP BY row_id, preset_value"""
SQL["abbrev_expand"] = f"""
  WITH tokens AS ({_TOKENS})
  SELECT row_id, preset_value, string_agg(coalesce(long, t), ' ' ORDER BY nth) AS expanded FROM tokens
  LEFT JOIN (VALUES ('max', 'maximum'), ('min', 'minimum'), ('nom', 'nominal'), ('typ', 'typical'), ('std', 'standard'),
    ('stdby', 'standby'), ('pwr', 'power'), ('gnd', 'ground'), ('ref', 'reference'), ('temp', 'temperature'), ('volt', 'voltage'),
    ('amp', 'current'), ('watt', 'power'), ('ohm', 'resistance'), ('farad', 'capacitance'), ('henry', 'inductance')) AS s(short, long)
    ON short = t GROUP BY row_id, preset_value"""

SQL["value_rules"] = rf"""
  SELECT row_id, preset_value, array_to_string({words(f"regexp_replace({norm('expanded')}, '[^a-z0-9_ ]', ' ', 'g')")}, ' ') AS form
  FROM ({SQL['abbrev_expand']})"""
SQL["key_index"] = f"""
  SELECT category, sub_category, attribute_name, row_number() OVER (PARTITION BY {_KEY} ORDER BY row_id) AS place, row_id, preset_value, {norm('preset_value')} AS normalized,
    {has_units('preset_value')} AS has_units, {has_numbers('preset_value')} AS has_numbers,
    contains(preset_value, ',') AS has_commas FROM ({REFERENCE})"""
SQL["preview"] = f"SELECT * FROM ({REFERENCE}) ORDER BY row_id LIMIT 20"

# ------------------------------------------------------------------ sources and sinks

SQL["distinct_over_versions"] = """
  WITH seen AS (SELECT * FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0),
  n AS (SELECT count(*) FILTER (o_orderkey % 3 <> 0) + count(*) FILTER (o_orderkey % 2 = 0) AS rows FROM orders)
  SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderpriority']) AS "column", n.rows AS "rows",
    unnest([count(DISTINCT o_orderkey), count(DISTINCT o_custkey), count(DISTINCT o_orderpriority)]) AS exact, true AS within_three_percent
  FROM seen, n GROUP BY n.rows"""
SQL["upsert_reference"] = f"""
  WITH refs AS ({REFERENCE}), edits AS (SELECT CASE WHEN row_id % 2 = 1 THEN row_id ELSE -1 - row_id END AS row_id,
      preset_value || ' new' AS preset_value FROM refs),
  final AS (SELECT row_id, preset_value FROM refs WHERE row_id NOT IN (SELECT row_id FROM edits)
      AND row_id NOT IN (SELECT 2 * s_suppkey FROM supplier)
    UNION ALL SELECT * FROM edits)
  SELECT row_id, preset_value, {norm('preset_value')} AS normalized, {has_units('preset_value')} AS has_units FROM final"""
SQL["snapshot_roundtrip"] = f"""
  SELECT row_id, category, sub_category, attribute_name, preset_value, {COMPUTED} FROM ({CLEANED})
  WHERE NOT (category = '' AND sub_category = '' AND attribute_name = '')"""
_POOLS = {
    "category": ["Switches", "Connectors", "Sensors", "Resistors", "Capacitors"],
    "sub_category": ["Push Button", "Terminal Block", "Temperature", "Carbon Film", "Ceramic"],
    "attribute_name": ["Brand", "Voltage", "Current", "Resistance", "Capacitance"],
    "input_value": ["EAO, 02", "24V", "1A", "10kΩ", "100µF", "IDEC, AL6", "12V", "2A", "1kΩ", "47µF"],
}
SQL["sample_data"] = "SELECT o_orderkey AS input_id, " + ", ".join(
    f"({pool})[1 + ('0x' || left(md5(o_orderkey || '|{name}|42'), 8))::BIGINT % {len(pool)}] AS {name}"
    for name, pool in _POOLS.items()
) + " FROM orders"
SQL["snapshot_info"] = f"""
  SELECT true AS "exists", true AS has_bytes, (SELECT count(*) FROM ({SQL['snapshot_roundtrip']})) AS n_rows"""


def all_sql():
    return dict(SQL)
