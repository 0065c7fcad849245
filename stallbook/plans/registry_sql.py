"""DuckDB SQL for the registered queries, written independently of them."""

from __future__ import annotations

from stallbook.functions import lexicon as lx

PRICE_OBS = """
obs AS (
  SELECT sha256(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE))) AS price_id,
         n_name AS state, concat('D', s_suppkey % 10) AS district, s_name AS market, p_brand AS commodity,
         l_returnflag AS variety, l_linestatus AS grade, CAST(l_shipdate AS DATE) AS arrival_date,
         floor((l_extendedprice - l_quantity) * 100 + 0.5) / 100 AS min_price,
         floor((l_extendedprice + l_quantity) * 100 + 0.5) / 100 AS max_price,
         floor(l_extendedprice * 100 + 0.5) / 100 AS modal_price
  FROM lineitem JOIN part ON l_partkey = p_partkey
                JOIN supplier ON l_suppkey = s_suppkey
                JOIN nation ON s_nationkey = n_nationkey)
"""

CALENDAR = """CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month,
         CAST(dayofweek(arrival_date) + 1 AS INT) AS day_of_week"""

DEDUPED = f"""
dedup AS (
  SELECT * EXCLUDE (nth), {CALENDAR}
  FROM (SELECT *, row_number() OVER (PARTITION BY arrival_date, market, commodity, variety ORDER BY price_id) AS nth
        FROM obs WHERE modal_price > 0 AND arrival_date IS NOT NULL)
  WHERE nth = 1)
"""


def micros(price: str) -> str:
    """The price as a whole number of millionths, for exact sums."""
    return f"CAST(CAST({price} AS DECIMAL(18, 6)) * 1000000 AS BIGINT)"


def mean(price: str, over: str = "") -> str:
    """Exact mean of a price, rounded half up to hundredths in whole numbers."""
    total, n = f"CAST(sum({micros(price)}) {over} AS HUGEINT)", f"count({price}) {over}"
    return f"CAST((2 * {total} + {n} * 10000) // (2 * {n} * 10000) AS DOUBLE) / 100"


def money(x: str) -> str:
    return f"CAST(round(CAST({x} AS DECIMAL(18, 6)), 2) AS DOUBLE)"


def half_up(x: str, digits: int = 2) -> str:
    return f"CAST(round(CAST(CAST({x} AS VARCHAR) AS DECIMAL(38, 18)), {digits}) AS DOUBLE)"


ENRICHED = f"""
before AS (
  SELECT *, lag({micros("modal_price")}) OVER s AS was, {micros("modal_price")} AS now
  FROM dedup WINDOW s AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id)),
enriched AS (
  SELECT * EXCLUDE (was, now),
         CASE WHEN was IS NULL THEN 0.0
              ELSE sign(now - was) * CAST((2 * CAST(abs(now - was) AS HUGEINT) * 10000 + was) // (2 * was) AS DOUBLE) / 100
         END AS price_change_pct,
         {mean("modal_price", "OVER w7")} AS moving_avg_7d,
         {mean("modal_price", "OVER w30")} AS moving_avg_30d,
         {half_up("(stddev_samp(modal_price) OVER w7)")} AS volatility_7d
  FROM before
  WINDOW w7 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id
                ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
         w30 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id
                 ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
"""

SQL: dict[str, str] = {}

SQL["gold_price_analytics"] = f"""
WITH {PRICE_OBS}
SELECT commodity, market, state, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month,
       count(*) AS total_records, count(DISTINCT arrival_date) AS trading_days,
       {mean("modal_price")} AS avg_modal_price,
       {money("min(modal_price)")} AS min_modal_price, {money("max(modal_price)")} AS max_modal_price,
       {half_up("stddev_samp(modal_price)")} AS price_stddev,
       {mean("min_price")} AS avg_min_price, {mean("max_price")} AS avg_max_price
FROM obs
WHERE modal_price > 0 AND arrival_date IS NOT NULL AND length(trim(commodity)) > 0
  AND state IS NOT NULL AND market IS NOT NULL
GROUP BY ALL
"""

SQL["silver_prices"] = f"WITH {PRICE_OBS}, {DEDUPED} SELECT * FROM dedup"

SQL["price_enriched"] = f"WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED} SELECT * FROM enriched"

SQL["commodity_summary"] = f"""
WITH {PRICE_OBS}
SELECT commodity, count(*) AS records, {mean("modal_price")} AS avg_price,
       {money("min(modal_price)")} AS min_price, {money("max(modal_price)")} AS max_price,
       min(arrival_date) AS earliest, max(arrival_date) AS latest
FROM obs GROUP BY commodity ORDER BY records DESC, commodity LIMIT 20
"""

SQL["commodity_analytics"] = f"""
WITH {PRICE_OBS}
SELECT commodity, count(*) AS total_records, count(DISTINCT market) AS num_markets,
       count(DISTINCT state) AS num_states, {mean("modal_price")} AS avg_price,
       {money("max(modal_price)")} AS max_price, {half_up("stddev_samp(modal_price)")} AS price_stddev,
       min(arrival_date) AS data_from, max(arrival_date) AS data_until
FROM obs GROUP BY commodity HAVING count(*) > 100 ORDER BY avg_price DESC, commodity LIMIT 10
"""

SQL["top_commodities"] = f"""
WITH {PRICE_OBS}
SELECT commodity, count(*) AS records, {mean("modal_price")} AS avg_price
FROM obs GROUP BY commodity ORDER BY records DESC, commodity LIMIT 10
"""

SQL["commodity_counts"] = f"""
WITH {PRICE_OBS}
SELECT commodity, count(*) AS count FROM obs GROUP BY commodity ORDER BY count DESC, commodity LIMIT 20
"""

TREND = f"""
trend AS (
  SELECT commodity, arrival_date, {mean("modal_price")} AS avg_price, {mean("moving_avg_7d")} AS ma_7d,
         {mean("moving_avg_30d")} AS ma_30d, count(*) AS records
  FROM enriched GROUP BY commodity, arrival_date)
"""

SQL["daily_trend"] = f"WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED}, {TREND} SELECT * FROM trend"

SQL["trend_overview"] = f"""
WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED}, {TREND}
SELECT commodity, count(*) AS data_points, min(arrival_date) AS first_day, max(arrival_date) AS last_day,
       {mean("avg_price")} AS avg_price
FROM trend GROUP BY commodity
"""


def raw_mean(price: str) -> str:
    return f"CAST(sum({micros(price)}) AS DOUBLE) / 1000000 / count({price})"


def tenths(price: str) -> str:
    """Mean price as a whole number of units of 1e-10."""
    return f"(2 * CAST(sum({micros(price)}) AS HUGEINT) * 10000 + count({price})) // (2 * count({price}))"


def series(keys: str) -> str:
    return f"""
daily AS (
  SELECT {keys}, arrival_date, {tenths("modal_price")} AS avg_price, {tenths("min_price")} AS min_price,
         {tenths("max_price")} AS max_price, count(modal_price) AS volume
  FROM obs GROUP BY {keys}, arrival_date)
"""


def rolled(keys: str, source: str) -> str:
    window = f"PARTITION BY {keys} ORDER BY arrival_date ROWS BETWEEN"

    def over(rows: str) -> str:
        total, n = (f"{f}(avg_price) OVER ({window} {rows} PRECEDING AND CURRENT ROW)" for f in ("sum", "count"))
        return f"CAST((2 * CAST({total} AS HUGEINT) + {n} * 1000000) // (2 * {n} * 1000000) AS DOUBLE) / 10000"

    def one(price: str) -> str:
        return f"CAST((2 * {price} + 1000000) // 2000000 AS DOUBLE) / 10000"

    return f"""
SELECT {keys}, arrival_date, volume, {one("avg_price")} AS avg_price, {one("min_price")} AS min_price,
       {one("max_price")} AS max_price, {over("6")} AS ma_7d, {over("29")} AS ma_30d
FROM {source}
"""


SQL["trend_last_n_days"] = f"""
WITH {PRICE_OBS}, {series("commodity, state")},
sized AS (SELECT *, count(*) OVER (PARTITION BY commodity, state) AS points,
                 max(arrival_date) OVER (PARTITION BY commodity, state) AS newest FROM daily),
cut AS (SELECT * FROM sized WHERE points <= 90 OR arrival_date >= newest - 90)
{rolled("commodity, state", "cut")}
"""

SQL["daily_prices"] = f"""
WITH {PRICE_OBS}, {series("commodity")}
{rolled("commodity", "daily")}
"""


def recent(keys: str) -> str:
    return f"""
recent AS (
  SELECT * FROM (SELECT *, max(arrival_date) OVER (PARTITION BY {keys}) AS newest FROM obs)
  WHERE arrival_date >= newest - 30)
"""


SQL["best_markets"] = f"""
WITH {PRICE_OBS}, {recent("commodity, state")},
means AS (
  SELECT commodity, state, market, {raw_mean("modal_price")} AS m, {mean("modal_price")} AS avg_price,
         {money("max(max_price)")} AS max_price, count(modal_price) AS data_points
  FROM recent GROUP BY commodity, state, market)
SELECT * EXCLUDE (m), CAST(row_number() OVER (PARTITION BY commodity, state ORDER BY m DESC, market) AS INT) AS rank
FROM means QUALIFY rank <= 10
"""

SQL["state_comparison"] = f"""
WITH {PRICE_OBS}, {recent("commodity")},
means AS (
  SELECT commodity, state, {raw_mean("modal_price")} AS m, {mean("modal_price")} AS avg_price
  FROM recent GROUP BY commodity, state),
top AS (
  SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY m DESC, state DESC) AS r
  FROM means QUALIFY r <= 5)
SELECT commodity, state, avg_price,
       CAST(row_number() OVER (PARTITION BY commodity ORDER BY r DESC) AS INT) AS position
FROM top
"""

SQL["latest_prices"] = f"""
WITH {PRICE_OBS}
SELECT market, state, commodity, modal_price, min_price, max_price, arrival_date,
       CAST(row_number() OVER (PARTITION BY commodity ORDER BY arrival_date DESC, price_id) AS INT) AS rank
FROM obs QUALIFY rank <= 15
"""


def outlook(keys: str) -> str:
    """Level by the plain recursion and forecast by stepping day by day."""
    same = " AND ".join(f"n.{k.strip()} = l.{k.strip()}" for k in keys.split(","))
    mine = ", ".join(f"n.{k.strip()}" for k in keys.split(","))
    return f"""
daily AS (
  SELECT {keys}, arrival_date, {raw_mean("modal_price")} AS price, count(*) AS n_rows
  FROM obs GROUP BY {keys}, arrival_date),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY arrival_date) AS i,
         row_number() OVER (PARTITION BY {keys} ORDER BY arrival_date DESC) AS back FROM daily),
levels AS (
  SELECT {keys}, i, price AS level FROM numbered WHERE i = 1
  UNION ALL
  SELECT {mine}, n.i, 0.3 * n.price + 0.7 * l.level
  FROM levels l JOIN numbered n ON {same} AND n.i = l.i + 1),
facts AS (
  SELECT {keys}, CAST(sum(n_rows) AS BIGINT) AS records, count(*) AS points, max(arrival_date) AS last_day,
         max(CASE WHEN back = 1 THEN price END) AS last_price,
         avg(CASE WHEN back <= 7 THEN price END) AS m7, avg(CASE WHEN back <= 30 THEN price END) AS m30
  FROM numbered GROUP BY {keys}),
state AS (
  SELECT f.*, l.level,
         CASE WHEN points >= 7 AND m30 > 0 THEN (m7 - m30) / m30 * 100 ELSE 0.0 END AS pct
  FROM facts f JOIN levels l ON {same.replace("n.", "f.")} AND l.i = f.points),
steps AS (
  SELECT {keys}, 1 AS day, last_day, last_price, pct, records,
         greatest(level * (1 + pct / 100 / 30), last_price * 0.7) AS price FROM state
  UNION ALL
  SELECT {keys}, day + 1, last_day, last_price, pct, records,
         greatest(price * (1 + pct / 100 / 30), last_price * 0.7) FROM steps WHERE day < 7)
"""


def label(pct: str) -> str:
    return f"CASE WHEN {pct} > 3 THEN 'rising' WHEN {pct} < -3 THEN 'falling' ELSE 'stable' END"


SQL["price_forecast"] = f"""
WITH RECURSIVE {PRICE_OBS}, {outlook("commodity, state")}
SELECT commodity, state, day, last_day + day AS date, {half_up("price")} AS predicted_price, {label("pct")} AS trend
FROM steps WHERE records >= 10
"""


def outlook_rows(keys: str) -> str:
    joined = ", ".join(f"s.{k.strip()}" for k in keys.split(","))
    return f"""
WITH RECURSIVE {PRICE_OBS}, {outlook(keys)},
means AS (
  SELECT {keys}, CAST(sum(CAST(floor(price * 100 + 0.5) AS BIGINT)) AS DOUBLE) / 7 / 100 AS forecast
  FROM steps GROUP BY {keys})
SELECT {joined}, CASE WHEN records >= 10 THEN 'ok' ELSE 'insufficient data' END AS status, records,
       CASE WHEN records >= 10 THEN points END AS points,
       CASE WHEN records >= 10 THEN last_day END AS last_day,
       CASE WHEN records >= 10 THEN {half_up("last_price")} END AS current_price,
       CASE WHEN records >= 10 THEN {half_up("forecast")} END AS forecast_avg,
       CASE WHEN records >= 10 THEN {half_up("pct")} END AS pct_change,
       CASE WHEN records >= 10 THEN {label("pct")} ELSE 'unknown' END AS trend
FROM state s JOIN means m USING ({keys})
"""


SQL["price_outlook"] = outlook_rows("commodity, state, market")
SQL["commodity_outlook"] = outlook_rows("commodity")

SQL["dimension_lists"] = f"""
WITH {PRICE_OBS}
SELECT commodity, list_sort(list(DISTINCT state)) AS state_list, list_sort(list(DISTINCT market)) AS market_list
FROM obs GROUP BY commodity
"""

SQL["market_choices"] = f"WITH {PRICE_OBS} SELECT DISTINCT commodity, state, market FROM obs WHERE market <> ''"

SQL["first_commodities"] = f"WITH {PRICE_OBS} SELECT DISTINCT commodity FROM obs ORDER BY commodity LIMIT 100"

SQL["rule_counts"] = f"""
WITH {PRICE_OBS}, flags AS (
  SELECT coalesce(modal_price > 0, false) AS a, arrival_date IS NOT NULL AS b,
         coalesce(length(trim(commodity)) > 0, false) AS c FROM obs)
SELECT 'valid_price' AS rule, count(*) AS rows, count_if(a) AS passed, count_if(NOT a) AS failed FROM flags
UNION ALL SELECT 'valid_date', count(*), count_if(b), count_if(NOT b) FROM flags
UNION ALL SELECT 'valid_commodity', count(*), count_if(c), count_if(NOT c) FROM flags
"""

SPACE = r"'[\s\x0b\x1c-\x1f\x{85}\p{Z}]+'"


def keyword_hits(whole_word: bool = False) -> str:
    found = (
        f"list_contains(string_split_regex(lower(d.text), {SPACE}), w.word)"
        if whole_word
        else "contains(lower(d.text), w.word)"
    )
    return f"""
qw AS (
  SELECT item_id AS query_id, word, count(*) AS times
  FROM (SELECT item_id, unnest(string_split_regex(lower(text), {SPACE})) AS word FROM benchmark)
  WHERE word <> '' GROUP BY ALL),
hits AS (SELECT d.doc_id, w.word FROM documents d, (SELECT DISTINCT word FROM qw) w WHERE {found}),
scores AS (
  SELECT query_id, doc_id AS chunk_id, CAST(sum(times) AS BIGINT) AS score
  FROM qw JOIN hits USING (word) GROUP BY ALL),
best AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INT) AS rank,
         chunk_id, score
  FROM scores QUALIFY rank <= 5)
"""


SQL["keyword_topk"] = f"WITH {keyword_hits()} SELECT * FROM best"
SQL["keyword_topk_whole_word"] = f"WITH {keyword_hits(True)} SELECT * FROM best"

SQL["context_assembly"] = f"""
WITH {keyword_hits()},
joined AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best JOIN documents ON doc_id = chunk_id GROUP BY query_id)
SELECT item_id AS query_id,
       coalesce('Based on available information:' || chr(10) || chr(10) || context,
                'I couldn''t find specific scheme information for your question. Please try asking about a specific '
                || 'scheme like PM-KISAN, PMFBY, KCC, e-NAM, or Soil Health Card.') AS answer
FROM benchmark LEFT JOIN joined ON query_id = item_id
"""

SQL["vector_topk"] = """
WITH parts AS (
  SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding) AS value FROM embeddings),
means AS (SELECT label, pos, avg(CAST(value AS DOUBLE)) AS value FROM parts GROUP BY ALL),
centres AS (SELECT label, list(value ORDER BY pos) AS centre FROM means GROUP BY label),
scores AS (
  SELECT c.label AS query_id, v.vec_id AS vector_id,
         list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), c.centre) AS score
  FROM centres c, embeddings v)
SELECT query_id, CAST(rank AS INT) AS rank, vector_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM scores) WHERE rank <= 5
"""

SQL["vector_neighbours"] = """
WITH scores AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vector_id,
         list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS score
  FROM embeddings q, embeddings v)
SELECT query_id, CAST(rank AS INT) AS rank, vector_id, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vector_id) AS rank FROM scores) WHERE rank <= 5
"""

SCHEMES = """
schemes AS (
  SELECT CAST(doc_id AS VARCHAR) AS scheme_id, 'Document ' || doc_id AS doc_name,
         CASE WHEN lang <> 'fr' THEN lang || ' text' ELSE 'Document ' || doc_id END AS name,
         lang AS category, text, source, n_chars
  FROM documents)
"""


def doc_chunks(eligibility: str, papers: str) -> str:
    return f"""
WITH {SCHEMES}
SELECT scheme_id, name, category, 'overview' AS chunk_type,
       concat('Scheme: ', name, chr(10), 'Category: ', category, chr(10), 'Description: ', text, chr(10),
              'Benefits: ', text, chr(10), 'Coverage: ', source) AS text
FROM schemes
UNION ALL
SELECT scheme_id, name, category, 'application',
       concat('Scheme: ', name, chr(10), 'Eligibility: ', {eligibility}, chr(10), 'How to Apply: ', chr(10),
              'Documents Required: ', {papers}, chr(10), 'Helpline: none', chr(10),
              'Official URL: https://example.com/', source)
FROM schemes
"""


SQL["doc_chunks"] = doc_chunks("category || '; ' || source", "source || ', ' || n_chars")
SQL["doc_chunks_bracketed"] = doc_chunks(
    "'[' || category || ', ' || source || ']'", "'[' || source || ', ' || n_chars || ']'"
)

SQL["chunk_files"] = SQL["doc_chunks"]

SQL["doc_list"] = f"""
WITH {SCHEMES}
SELECT scheme_id, name, doc_name AS short_name, category, substring(text, 1, 100) || '...' AS benefits_summary
FROM schemes
"""

GUIDE = """
guide AS (
  SELECT p_brand AS crop, p_type AS growth_stage, split_part(p_name, ' ', 2) AS category,
         concat('Crop: ', p_brand, chr(10), 'Growth Stage: ', p_type, chr(10), 'Category: ',
                split_part(p_name, ' ', 2), chr(10), 'Problem: ', split_part(p_name, ' ', 1), chr(10), 'Product: ',
                p_name, chr(10), 'Dosage: ', p_size, chr(10), 'Application Method: ', chr(10), 'Timing: any', chr(10),
                'Precautions: ₹', chr(10), 'Organic Alternative: ', chr(10), 'Cost Estimate: ', p_partkey) AS text
  FROM part)
"""

SQL["guide_chunks"] = f"WITH {GUIDE} SELECT * FROM guide"

SQL["guide_lists"] = f"""
WITH {GUIDE}
SELECT crop, string_agg(growth_stage, ', ' ORDER BY growth_stage) AS growth_stages
FROM (SELECT DISTINCT crop, growth_stage FROM guide) GROUP BY crop
"""

SQL["guide_categories"] = f"WITH {GUIDE} SELECT DISTINCT category FROM guide WHERE category <> ''"

SQL["guide_recommendations"] = f"""
WITH {GUIDE},
requests AS (
  SELECT growth_stage || '/' || category AS query_id,
         max(crop) || ' ' || growth_stage || ' ' || category
           || CASE WHEN category = 'ring' THEN ' organic biological natural' ELSE '' END AS text
  FROM guide GROUP BY growth_stage, category),
qw AS (
  SELECT query_id, word, count(*) AS times
  FROM (SELECT query_id, unnest(string_split(lower(text), ' ')) AS word FROM requests) GROUP BY ALL),
texts AS (SELECT sha256(concat(length(crop), ':', crop, length(growth_stage), ':', growth_stage, length(category), ':', category,
                                 length(text), ':', text)) AS chunk_id, text FROM guide),
scores AS (
  SELECT query_id, chunk_id, text, sum(times) AS score
  FROM qw JOIN texts ON contains(lower(text), word) GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank
  FROM scores QUALIFY rank <= 5),
joined AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best GROUP BY query_id)
SELECT query_id, r.text, 'Based on available guidance:' || chr(10) || chr(10) || context AS answer
FROM requests r JOIN joined USING (query_id)
"""

TONGUES = {
    "english": ("the", "tion", "and", "with"),
    "german": ("der", "ung", "und", "sch"),
    "french": ("eau", "que", "les", "des"),
    "spanish": ("los", "ción", "por", "una"),
}


def intents(source: str, columns: str, lexicon, whole_word: bool = False) -> str:
    def hit(word: str) -> str:
        if whole_word:
            return f"CAST(regexp_matches(clean, '(^|[^\\p{{L}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{N}}_])') AS INT)"
        return f"CAST(contains(clean, '{word}') AS INT)"

    scores = ", ".join(f"{' + '.join(hit(w) for w in words)} AS n_{i}" for i, words in lexicon.items())
    names = [f"n_{i}" for i in lexicon]
    cases = " ".join(f"WHEN n_{i} = best THEN '{i}'" for i in lexicon)
    return f"""
cleaned AS (SELECT *, trim(lower(coalesce(text, '')), ' ' || chr(10) || chr(9)) AS clean FROM {source}),
scored AS (SELECT *, {scores} FROM cleaned),
summed AS (SELECT *, greatest({", ".join(names)}) AS best, {" + ".join(names)} AS total FROM scored),
intents AS (
  SELECT {columns}, text, CASE WHEN clean = '' OR best = 0 THEN 'general' {cases} END AS intent,
         CASE WHEN clean = '' THEN 0.0 WHEN best = 0 THEN 0.3
              ELSE {half_up("(CAST(best AS DOUBLE) / total)")} END AS confidence
  FROM summed)
"""


TURN = "conv_id, turn, role"
SQL["intent_classify"] = f"WITH {intents('conversations', TURN, TONGUES)} SELECT * EXCLUDE (text) FROM intents"
SQL["intent_classify_whole_word"] = (
    f"WITH {intents('conversations', TURN, TONGUES, True)} SELECT * EXCLUDE (text) FROM intents"
)
SQL["intent_classify_default"] = (
    f"WITH {intents('documents', 'doc_id', lx.INTENT_KEYWORDS)} SELECT * EXCLUDE (text) FROM intents"
)
SQL["question_routes"] = f"""
WITH {intents('conversations', TURN, lx.INTENT_KEYWORDS)}
SELECT * EXCLUDE (text), CASE intent WHEN 'general' THEN 'general' ELSE intent || '_tab' END AS feature,
       substring(text, 1, 100) AS preview
FROM intents
"""
SQL["routing_counts"] = f"""
WITH {intents('conversations', TURN, TONGUES)}
SELECT intent, intent AS feature, count(*) AS questions,
       {half_up("(sum(CAST(floor(confidence * 100 + 0.5) AS BIGINT)) / count(*) / 100)", 4)} AS avg_confidence
FROM intents GROUP BY intent
"""


def first_of(names) -> str:
    return " ".join(f"WHEN contains(lower(text), '{n}') THEN '{n.title()}'" for n in names)


SQL["entity_extract"] = f"""
SELECT {TURN}, CASE {first_of(("thing", "heit", "eau", "ing"))} END AS commodity,
       CASE {first_of(("ment", "sch", "ble"))} ELSE 'General' END AS crop
FROM conversations
"""
SQL["entity_extract_default"] = f"""
SELECT doc_id, CASE {first_of(lx.COMMODITY_NAMES)} END AS commodity,
       CASE {first_of(lx.CROP_NAMES)} ELSE 'General' END AS crop
FROM documents
"""

LABELS = """
marked AS (
  SELECT doc_id, lang, CASE WHEN source = 'src1' THEN 'healthy' ELSE 'spots' END AS condition,
         'Doc_' || lang || '___' || CASE WHEN source = 'src1' THEN 'healthy' ELSE 'spots' END || '_' || doc_id AS label
  FROM documents)
"""

SQL["label_lookup"] = f"""
WITH {LABELS}
SELECT m.doc_id, label, 'Doc ' || lang AS crop, condition || ' ' || m.doc_id AS disease,
       condition = 'healthy' AS is_healthy,
       CASE condition WHEN 'healthy' THEN 'Healthy' ELSE 'Disease Detected' END AS status,
       coalesce('quality ' || quality, 'Consult a local agriculture expert.') AS treatment,
       coalesce('toxic ' || toxic, 'Practice good farm hygiene.') AS prevention,
       CASE WHEN toxic = 0 THEN 'none needed' ELSE 'Use neem-based sprays.' END AS organic
FROM marked m LEFT JOIN labels l ON l.doc_id = m.doc_id
"""

SQL["ingest_labels"] = f"""
WITH {LABELS} SELECT doc_id, 'Doc' AS crop, condition || ' ' || doc_id AS disease_name FROM marked
"""

SQL["top_predictions"] = f"""
WITH scores AS (
  SELECT l_suppkey AS image_id, p_brand AS label, sum(l_quantity) / 8192 AS score
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)
SELECT image_id, CAST(row_number() OVER (PARTITION BY image_id ORDER BY scores.score DESC, label) AS INT) AS rank, label,
       {half_up("scores.score", 4)} AS score,
       printf('%.1f%%', {half_up("(" + half_up("scores.score", 4) + " * 100)", 1)}) AS confidence
FROM scores QUALIFY rank <= 5
"""

VERSIONS = """
changed AS (
  SELECT * REPLACE ('F' AS o_orderstatus) FROM orders WHERE o_orderstatus = 'P'
  UNION ALL SELECT * REPLACE (-o_orderkey - 1 AS o_orderkey) FROM orders WHERE o_orderpriority = '1-URGENT'),
merged AS (
  SELECT * FROM changed
  UNION ALL SELECT * FROM orders o WHERE NOT EXISTS (SELECT 1 FROM changed c WHERE c.o_orderkey = o.o_orderkey))
"""

SQL["table_merge"] = f"WITH {VERSIONS} SELECT * FROM merged"

SQL["upsert"] = f"WITH {VERSIONS} SELECT * FROM merged"

SQL["snapshot_diff"] = f"""
WITH {VERSIONS}, later AS (SELECT * FROM merged WHERE o_orderpriority <> '5-LOW')
SELECT *, 'insert' AS change, CAST(1 AS BIGINT) AS copies FROM later WHERE o_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL
SELECT *, 'delete', 1 FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM later)
UNION ALL
SELECT *, 'update', 1 FROM (SELECT * FROM later EXCEPT SELECT * FROM orders)
WHERE o_orderkey IN (SELECT o_orderkey FROM orders)
"""

SQL["append_evolving"] = """
SELECT c_name AS name, c_mktsegment, CAST(NULL AS DOUBLE) AS s_acctbal FROM customer
UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier
"""

SQL["table_append"] = SQL["append_evolving"]

SQL["key_check"] = """
WITH keys AS (SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT CAST(sum(n) AS BIGINT) AS rows, CAST(0 AS BIGINT) AS null_keys, count_if(n > 1) AS repeated_keys,
       CAST(sum(n - 1) AS BIGINT) AS surplus_rows
FROM keys
"""

SQL["repeated_keys"] = """
SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY ALL HAVING count(*) > 1
"""

RULES = "l_quantity <= 45 AS a, l_tax > 0 AS b, l_linestatus = 'F' AS c"

SQL["quarantine"] = """
SELECT *, list_filter([CASE WHEN l_quantity > 45 THEN 'quantity_up_to_45' END, CASE WHEN l_tax <= 0 THEN 'taxed' END,
                       CASE WHEN l_linestatus <> 'F' THEN 'finished' END], lambda x: x IS NOT NULL) AS failed_rules
FROM lineitem WHERE NOT (l_quantity <= 45 AND l_tax > 0 AND l_linestatus = 'F')
"""

SQL["line_rule_counts"] = f"""
WITH flags AS (SELECT {RULES} FROM lineitem)
SELECT 'quantity_up_to_45' AS rule, count(*) AS rows, count_if(a) AS passed, count_if(NOT a) AS failed FROM flags
UNION ALL SELECT 'taxed', count(*), count_if(b), count_if(NOT b) FROM flags
UNION ALL SELECT 'finished', count(*), count_if(c), count_if(NOT c) FROM flags
"""

SQL["valid_lines"] = "SELECT * FROM lineitem WHERE l_quantity <= 45 AND l_tax > 0 AND l_linestatus = 'F'"

SQL["table_counts"] = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*) AS row_count, CAST({n} AS INT) AS column_count FROM {t}"
    for t, n in {
        "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
        "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
    }.items()
)

SQL["filtered_read"] = """
SELECT * FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH')
"""

SQL["stream_silver"] = f"""
WITH {PRICE_OBS}
SELECT *, {CALENDAR} FROM obs
WHERE modal_price > 0 AND arrival_date IS NOT NULL AND length(trim(commodity)) > 0
  AND state IS NOT NULL AND market IS NOT NULL
"""

SQL["stream_dedupe"] = f"WITH {PRICE_OBS} SELECT DISTINCT arrival_date, market, commodity, variety FROM obs"

SQL["stream_unique"] = SQL["silver_prices"]

SQL["stream_gold"] = SQL["gold_price_analytics"]

SQL["lagged_features"] = f"""
WITH {PRICE_OBS}, {DEDUPED}
SELECT price_id, {mean("modal_price", "OVER w7")} AS lagged_avg_7d, {mean("modal_price", "OVER w30")} AS lagged_avg_30d
FROM dedup
WINDOW w7 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id
              ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING),
       w30 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id
               ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)
"""

FILE_COLUMNS = "state, district, market, commodity, variety, grade, arrival_date, min_price, max_price, modal_price"
SQL["price_files_json"] = f"WITH {PRICE_OBS} SELECT {FILE_COLUMNS} FROM obs WHERE grade = 'F' AND modal_price > 0"
SQL["price_files_csv"] = SQL["price_files_json"]
SQL["stream_ingest"] = f"""
WITH {PRICE_OBS}
SELECT * REPLACE (CASE WHEN grade = 'F' THEN modal_price END AS modal_price) FROM (SELECT {FILE_COLUMNS} FROM obs)
"""

SQL["price_log"] = f"""
WITH RECURSIVE {PRICE_OBS}, {outlook("commodity, state")}
SELECT commodity, '' AS market, state, {half_up("price")} AS predicted_price, day AS days_ahead, 'latest' AS model_version
FROM steps WHERE records >= 10
"""

SQL["chat_log"] = f"""
WITH {intents('conversations', TURN, TONGUES)}
SELECT coalesce(text, '') AS user_query, intent, substring(coalesce(text, ''), 1, 500) AS response_summary,
       'en' AS language, intent AS feature_used
FROM intents
"""

SQL["disease_log"] = f"""
WITH {LABELS}
SELECT label AS predicted_disease, 'Doc ' || lang AS predicted_crop, CAST(0 AS DOUBLE) AS confidence, '' AS treatment,
       'latest' AS model_version, 'en' AS user_language
FROM marked
"""

ERRORS = "errors AS (SELECT *, moving_avg_7d - modal_price AS e FROM enriched WHERE modal_price > 0)"

SQL["average_eval"] = f"""
WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED}, {ERRORS}
SELECT count(*) AS samples, {half_up("sqrt(avg(e * e))", 4)} AS rmse, {half_up("avg(abs(e))", 4)} AS mae,
       {half_up("(1 - sum(e * e) / (var_pop(modal_price) * count(*)))", 4)} AS r2
FROM errors
"""

SQL["average_error_by_commodity"] = f"""
WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED}, {ERRORS},
per AS (SELECT commodity, count(*) AS samples, sqrt(avg(e * e)) AS a, avg(abs(e)) AS b FROM errors GROUP BY commodity)
SELECT commodity, samples, {half_up("a", 4)} AS rmse, {half_up("b", 4)} AS mae
FROM per ORDER BY a, commodity LIMIT 10
"""

SQL["average_residuals"] = f"""
WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED}, {ERRORS}
SELECT commodity, market, arrival_date, modal_price, moving_avg_7d AS prediction, {half_up("e")} AS error,
       {half_up("(e / modal_price * 100)")} AS error_pct
FROM errors
"""


def unit_price(value: str) -> str:
    return f"(CAST(floor({value} * 100 + 0.5) AS BIGINT) * 100 // CAST(l_quantity AS BIGINT)) / 10000"


UNIT_OBS = PRICE_OBS
for _value in ("(l_extendedprice - l_quantity)", "(l_extendedprice + l_quantity)", "l_extendedprice"):
    UNIT_OBS = UNIT_OBS.replace(f"floor({_value} * 100 + 0.5) / 100", unit_price(f"(floor({_value} * 100 + 0.5) / 100)"))
for _unit, _whole in {
    "unit_price_analytics": "gold_price_analytics",
    "unit_price_enriched": "price_enriched",
    "unit_price_summary": "commodity_analytics",
    "unit_price_markets": "best_markets",
    "unit_price_trend": "trend_last_n_days",
    "unit_price_forecast": "price_forecast",
}.items():
    SQL[_unit] = SQL[_whole].replace(PRICE_OBS, UNIT_OBS)

SQL["table_merge_nulls"] = f"""
WITH {VERSIONS} SELECT * REPLACE (nullif(o_orderstatus, 'O') AS o_orderstatus) FROM merged
"""

SQL["snapshot_diff_columns"] = f"""
WITH {VERSIONS},
before AS (SELECT * EXCLUDE (o_orderpriority), CAST(NULL AS VARCHAR) AS o_orderpriority FROM orders),
later AS (SELECT * EXCLUDE (o_totalprice), CAST(NULL AS DOUBLE) AS o_totalprice FROM merged)
SELECT l.*, CASE WHEN b.o_orderkey IS NULL THEN 'insert' ELSE 'update' END AS change, CAST(1 AS BIGINT) AS copies
FROM later l LEFT JOIN before b USING (o_orderkey)
"""

FILE_ROWS = f"""
SELECT * REPLACE (CASE WHEN grade = 'F' THEN modal_price END AS modal_price) FROM (SELECT {FILE_COLUMNS} FROM obs)
"""
SQL["price_files_lineage"] = f"""
WITH {PRICE_OBS} SELECT 'grade_' || grade AS place, grade, count(*) AS rows FROM obs GROUP BY grade
"""
SQL["price_files_remembered"] = f"""
WITH {PRICE_OBS} SELECT * REPLACE (CAST(NULL AS VARCHAR) AS variety) FROM ({FILE_ROWS})
"""
SQL["stream_ingest_by_name"] = f"WITH {PRICE_OBS} {FILE_ROWS}"
SQL["scheme_files"] = SQL["doc_chunks"]
SQL["guide_files"] = SQL["guide_chunks"]
SQL["price_log_table"] = SQL["price_log"]
SQL["search_auto"] = SQL["keyword_topk"]

SQL["doc_detail"] = """
SELECT CAST(doc_id AS VARCHAR) AS scheme_id, 'Document ' || doc_id AS name,
       CASE WHEN lang <> 'fr' THEN lang || ' text' END AS name_en, lang AS category, text AS description,
       [lang, source] AS eligibility, text AS benefits, CAST(NULL AS VARCHAR) AS how_to_apply,
       [source, CAST(n_chars AS VARCHAR)] AS documents_required, 'https://example.com/' || source AS official_url,
       'none' AS helpline, source AS coverage
FROM documents WHERE doc_id = 7
"""

AWKWARD = """
awkward AS (
  SELECT doc_id, list_extract(['Pepper,_bell___Bacterial_spot', 'Corn_(maize)___Common_rust_',
           'Corn_(maize)___Cercospora_leaf_spot Gray_leaf_spot', 'Tomato___Spider_mites Two-spotted_spider_mite',
           'Grape___healthy', 'no separator', ''], CAST(doc_id % 8 + 1 AS INT)) AS label
  FROM documents),
parsed AS (
  SELECT doc_id, label, replace(split_part(label, '___', 1), '_', ' ') AS crop,
         CASE WHEN contains(label, '___') THEN replace(split_part(label, '___', 2), '_', ' ') ELSE 'Unknown' END AS disease
  FROM awkward),
judged AS (
  SELECT *, contains(lower(disease), 'healthy') AS is_healthy,
         CASE WHEN contains(lower(disease), 'healthy') THEN 'Healthy' ELSE 'Disease Detected' END AS status
  FROM parsed)
"""
SQL["awkward_labels"] = f"WITH {AWKWARD} SELECT * FROM judged"
SQL["repeated_labels"] = f"""
WITH {AWKWARD},
known AS (SELECT label, max(doc_id) AS last FROM awkward WHERE label <> '' GROUP BY label)
SELECT j.*, coalesce(CAST(last AS VARCHAR), 'Consult a local agriculture expert.') AS treatment,
       CASE WHEN last IS NULL THEN 'Practice good farm hygiene.' ELSE 'p' END AS prevention,
       'Use neem-based sprays.' AS organic
FROM judged j LEFT JOIN known USING (label)
"""
SQL["knowledge_files"] = f"""
WITH {AWKWARD}
SELECT label AS disease_class, regexp_extract(label, '^([^_]+)', 1) AS crop,
       replace(regexp_extract(label, '___(.+)$', 1), '_', ' ') AS disease_name, CAST(doc_id AS VARCHAR) AS treatment,
       'p' AS prevention, 'o' AS organic
FROM awkward
"""

SQL["bounded_read"] = """
SELECT o_orderstatus, least(count(*), 100) AS rows FROM orders WHERE o_orderstatus = 'F' GROUP BY o_orderstatus
"""
SQL["free_sql"] = """
SELECT o_custkey, sum(o_totalprice) > 1000000 AS large, count(*) AS orders FROM orders GROUP BY o_custkey
"""

SQL["stream_unique_batches"] = SQL["silver_prices"].replace(
    PRICE_OBS, PRICE_OBS.replace("l_returnflag AS variety", "nullif(l_returnflag, 'A') AS variety")
)
SQL["stream_gold_batches"] = SQL["gold_price_analytics"]
SQL["stream_dedupe_events"] = "SELECT * FROM events"

CHOSEN_OBS = PRICE_OBS.replace("s_nationkey = n_nationkey)", "s_nationkey = n_nationkey WHERE p_brand = 'Brand#13')")
SQL["report_trend"] = f"""
WITH {CHOSEN_OBS}, {series("commodity")},
sized AS (SELECT *, count(*) OVER (PARTITION BY commodity) AS points, max(arrival_date) OVER (PARTITION BY commodity) AS newest
          FROM daily),
cut AS (SELECT * FROM sized WHERE points <= 90 OR arrival_date >= newest - 90)
{rolled("commodity", "cut")}
"""
SQL["report_forecast"] = f"""
WITH RECURSIVE {CHOSEN_OBS}, {outlook("commodity")}
SELECT commodity, day, last_day + day AS date, {half_up("price")} AS predicted_price, {label("pct")} AS trend
FROM steps WHERE records >= 10
"""
SQL["report_outlook"] = SQL["commodity_outlook"].replace(PRICE_OBS, CHOSEN_OBS)
SQL["report_current_prices"] = SQL["latest_prices"].replace(PRICE_OBS, CHOSEN_OBS)

_INDEXES = ", ".join(
    f"(SELECT {c}, CAST(row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS DOUBLE) AS {c}_idx FROM kept GROUP BY {c}) AS i_{c}"
    for c in ("commodity", "market", "state")
)
_NAMES = (
    "year", "month", "day_of_week", "commodity_idx", "market_idx", "state_idx", "moving_avg_7d", "moving_avg_30d",
)
SQL["model_features"] = f"""
WITH {PRICE_OBS}, {DEDUPED}, {ENRICHED},
kept AS (SELECT * FROM enriched WHERE modal_price > 0 AND moving_avg_7d IS NOT NULL AND moving_avg_30d IS NOT NULL),
rows AS (
  SELECT k.*, commodity_idx, market_idx, state_idx FROM kept k, {_INDEXES}
  WHERE k.commodity = i_commodity.commodity AND k.market = i_market.market AND k.state = i_state.state)
SELECT price_id, commodity_idx, market_idx, state_idx,
       {", ".join(f"round((CAST({n} AS DOUBLE) - avg({n}) OVER ()) / stddev_samp({n}) OVER (), 4) AS {n}_std" for n in _NAMES)}
FROM rows
"""

SQL["model_split"] = f"""
WITH {PRICE_OBS}
SELECT price_id, CASE WHEN CAST('0x' || substring(md5('42-' || price_id), 1, 8) AS BIGINT) / 4294967296.0 < 0.8
                      THEN 'train' ELSE 'test' END AS part
FROM obs
"""

SQL["text_weights"] = """
WITH terms AS (
  SELECT doc_id, unnest(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')) AS term FROM documents),
counts AS (
  SELECT doc_id AS chunk_id, CAST(CAST('0x' || substring(md5(term), 1, 8) AS BIGINT) % 384 AS INT) AS place, count(*) AS times
  FROM terms WHERE term <> '' GROUP BY ALL),
rarity AS (
  SELECT place, ln(((SELECT count(*) FROM documents WHERE text IS NOT NULL) + 1) / CAST(count(*) + 1 AS DOUBLE)) AS rarity
  FROM counts GROUP BY place),
weighed AS (SELECT chunk_id, place, times * rarity AS weight FROM counts JOIN rarity USING (place)),
lengths AS (SELECT chunk_id, sqrt(sum(weight * weight)) AS length FROM weighed GROUP BY chunk_id)
SELECT chunk_id, place, round(weight / length, 5) AS weight FROM weighed JOIN lengths USING (chunk_id) WHERE weight <> 0
"""

SQL["ask_schemes"] = f"""
WITH chunked AS ({SQL["doc_chunks"]}),
texts AS (
  SELECT DISTINCT sha256(concat(length(scheme_id), ':', scheme_id, length(chunk_type), ':', chunk_type, length(text), ':',
                                text)) AS chunk_id, text
  FROM chunked),
qw AS (
  SELECT item_id AS query_id, word, count(*) AS times
  FROM (SELECT item_id, unnest(string_split_regex(lower(text), {SPACE})) AS word FROM benchmark)
  WHERE word <> '' GROUP BY ALL),
hits AS (
  SELECT chunk_id, word FROM texts, (SELECT DISTINCT word FROM qw) w WHERE contains(lower(texts.text), w.word)),
scores AS (SELECT query_id, chunk_id, sum(times) AS score FROM qw JOIN hits USING (word) GROUP BY ALL),
best AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scores QUALIFY rank <= 5),
joined AS (
  SELECT query_id, string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best JOIN texts USING (chunk_id) GROUP BY query_id)
SELECT item_id AS query_id, 'Based on available information:' || chr(10) || chr(10) || context AS answer
FROM benchmark JOIN joined ON query_id = item_id
"""

SQL["table_comments"] = """
SELECT column_name AS name, column_name || ' of an order, it''s' AS comment, 'Orders: what''s new' AS about,
       (SELECT count(*) FROM orders) AS rows
FROM (DESCRIBE orders)
"""

SQL["dimension_pages"] = f"""
WITH {PRICE_OBS}, places AS (SELECT DISTINCT commodity, market FROM obs WHERE market <> ''),
ranked AS (SELECT *, row_number() OVER (PARTITION BY commodity ORDER BY market) AS rank FROM places)
SELECT commodity, (rank - 1) // 7 + 1 AS page, list(market ORDER BY market) AS market_page FROM ranked GROUP BY ALL
"""


def nanos(column: str) -> str:
    """A wide price as a whole number of thousand-millionths, from its definition."""
    units, hundredths = f"CAST(floor({column}) AS HUGEINT)", f"CAST(floor({column} * 100 + 0.5) AS HUGEINT)"
    return f"""CASE variety WHEN 'R' THEN {units} * CAST(1000000000000 AS HUGEINT) * 1000000000
               WHEN 'A' THEN {units} % 1000 * 1000000000 + {hundredths} % 997 ELSE {hundredths} * 10000000 END"""


def from_nanos(total: str, n: str = "1") -> str:
    """Total by number, rounded half up to hundredths, as the nearest double."""
    whole = f"((2 * {total} + {n} * CAST(10000000 AS HUGEINT)) // ({n} * CAST(20000000 AS HUGEINT)))"
    return f"CAST(CAST({whole} // 100 AS VARCHAR) || '.' || lpad(CAST({whole} % 100 AS VARCHAR), 2, '0') AS DOUBLE)"


WIDE_OBS = f"""
{PRICE_OBS}, wide AS (
  SELECT * EXCLUDE (modal_price, min_price, max_price), {nanos("modal_price")} AS modal, {nanos("min_price")} AS low,
         {nanos("max_price")} AS high FROM obs)
"""


def wide_mean(column: str, over: str = "") -> str:
    return from_nanos(f"CAST(sum({column}) {over} AS HUGEINT)", f"count(*) {over}")


SQL["wide_price_analytics"] = f"""
WITH {WIDE_OBS}
SELECT commodity, market, state, CAST(year(arrival_date) AS INT) AS year, CAST(month(arrival_date) AS INT) AS month,
       count(*) AS total_records, count(DISTINCT arrival_date) AS trading_days,
       {wide_mean("modal")} AS avg_modal_price,
       {from_nanos("min(modal)")} AS min_modal_price, {from_nanos("max(modal)")} AS max_modal_price,
       {wide_mean("low")} AS avg_min_price, {wide_mean("high")} AS avg_max_price
FROM wide WHERE modal > 0 GROUP BY ALL
"""

SQL["wide_price_enriched"] = f"""
WITH {WIDE_OBS}, kept AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY arrival_date, market, commodity, variety ORDER BY price_id) AS nth
                 FROM wide WHERE modal > 0) WHERE nth = 1)
SELECT price_id, CASE WHEN variety = 'A' THEN CAST(modal AS DOUBLE) / 1000000000
                      WHEN variety = 'R' THEN CAST(modal // 1000000000 AS DOUBLE)
                      ELSE CAST(modal // 10000000 AS DOUBLE) / 100 END AS modal_price,
       {wide_mean("modal", "OVER w7")} AS moving_avg_7d, {wide_mean("modal", "OVER w30")} AS moving_avg_30d
FROM kept
WINDOW w7 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id ROWS BETWEEN 6 PRECEDING AND CURRENT ROW),
       w30 AS (PARTITION BY commodity, market ORDER BY arrival_date, variety, price_id ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)
"""

SQL["price_files_rescued"] = f"""
WITH {PRICE_OBS}
SELECT 'loaded' AS rule, variety, count(*) AS rows, count_if(grade = 'F') AS prices FROM obs WHERE variety <> 'A' GROUP BY ALL
UNION ALL SELECT 'broken_line', NULL, count(*), 0 FROM obs WHERE variety = 'A' HAVING count(*) > 0
UNION ALL SELECT 'unexpected_column', 'Moisture', count(*), 0 FROM obs WHERE variety = 'R' HAVING count(*) > 0
"""

SQL["rescued_lines"] = f"""
WITH {PRICE_OBS}
SELECT substring('{{"State":"' || state || '","District Name":"' || district || '","Market Name":"' || market ||
                 '","Commodity":"' || commodity, 1, 60) AS content, count(*) AS rows
FROM obs WHERE variety = 'A' GROUP BY ALL
"""

SQL["vector_index_topk"] = SQL["vector_topk"]
SQL["vector_index_neighbours"] = SQL["vector_neighbours"]
SQL["vector_index_cells"] = "SELECT vec_id, true AS inside FROM embeddings WHERE embedding IS NOT NULL"

SQL["upsert_repeated_keys"] = f"""
WITH {VERSIONS}, latest AS (
  SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 3 = 0 THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
         * EXCLUDE (o_orderkey, o_custkey, o_orderstatus) FROM changed)
SELECT * FROM latest UNION ALL SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM changed)
"""

BACK = """
thinned AS (SELECT * FROM merged WHERE o_orderkey % 5 <> 0),
back AS (SELECT * REPLACE ('B' AS o_orderstatus) FROM orders WHERE o_orderkey % 10 = 0)
"""
SQL["apply_changes"] = f"WITH {VERSIONS}, {BACK} SELECT * FROM thinned UNION ALL SELECT * FROM back"
SQL["change_intervals"] = f"""
WITH {VERSIONS}, {BACK}, events AS (
  SELECT o_orderkey, o_orderstatus, 0 AS valid_from, false AS deleted FROM orders
  UNION ALL SELECT o_orderkey, o_orderstatus, 1, false FROM changed
  UNION ALL SELECT o_orderkey, NULL, 2, true FROM merged WHERE o_orderkey % 5 = 0
  UNION ALL SELECT o_orderkey, o_orderstatus, 3, false FROM back)
SELECT o_orderkey, o_orderstatus, valid_from, lead(valid_from) OVER (PARTITION BY o_orderkey ORDER BY valid_from) AS valid_to, deleted
FROM events
"""

SQL["bucketed_enriched"] = SQL["price_enriched"]
SQL["bucketed_merge"] = SQL["upsert"]
SQL["table_inventory"] = "\nUNION ALL ".join(
    [
        f"SELECT '{t}' AS name, (SELECT count(*) FROM {t}) AS row_count, CAST((SELECT count(*) FROM (DESCRIBE {t})) AS INT) AS column_count, true AS found"
        for t in ("nation", "orders", "documents")
    ]
    + ["SELECT 'absent', NULL, NULL, false"]
)

SQL["stream_unique_empty_first"] = SQL["silver_prices"]
SQL["stream_gold_states"] = SQL["gold_price_analytics"]
SQL["stream_survivors"] = SQL["stream_unique_batches"]

ODD_FLAGS = f"""
{PRICE_OBS}, flags AS (
  SELECT variety <> 'R' AS a, grade <> 'O' AS b, commodity <> 'Brand#13' AS c FROM obs)
"""
SQL["stream_rule_counts"] = f"""
WITH {ODD_FLAGS}
SELECT 'valid_price' AS rule, count(*) AS rows, count_if(a) AS passed, count_if(NOT a) AS failed FROM flags
UNION ALL SELECT 'valid_date', count(*), count_if(b), count_if(NOT b) FROM flags
UNION ALL SELECT 'valid_commodity', count(*), count_if(c), count_if(NOT c) FROM flags
"""
SQL["valid_rows_observed"] = f"""
WITH {ODD_FLAGS}
SELECT 'valid_price' AS rule, count(*) AS rows, count_if(NOT a) AS failed, count_if(a AND b AND c) AS kept FROM flags
UNION ALL SELECT 'valid_date', count(*), count_if(NOT b), count_if(a AND b AND c) FROM flags
UNION ALL SELECT 'valid_commodity', count(*), count_if(NOT c), count_if(a AND b AND c) FROM flags
"""

SQL["tree_stump"] = f"""
WITH {PRICE_OBS}, binned AS (
  SELECT modal_price AS y, CAST(dayofweek(arrival_date) + 1 AS DOUBLE) AS weekday, CAST(month(arrival_date) AS DOUBLE) AS month,
         CAST(least(floor(min_price / 20000), 4) AS DOUBLE) AS level FROM obs),
long AS (UNPIVOT binned ON weekday, month, level INTO NAME feature VALUE x),
by_value AS (SELECT feature, x, count(*) AS n, sum(y) AS s FROM long GROUP BY ALL),
sides AS (
  SELECT feature, (x + lead(x) OVER v) / 2 AS threshold, sum(n) OVER v AS n1, sum(s) OVER v AS s1,
         sum(n) OVER (PARTITION BY feature) AS n, sum(s) OVER (PARTITION BY feature) AS s
  FROM by_value WINDOW v AS (PARTITION BY feature ORDER BY x)),
best AS (
  SELECT * FROM sides WHERE threshold IS NOT NULL ORDER BY s1 * s1 / n1 + (s - s1) * (s - s1) / (n - n1) DESC LIMIT 1)
SELECT feature, threshold, true AS below, {half_up("s1 / n1", 4)} AS prediction, CAST(n1 AS BIGINT) AS rows FROM best
UNION ALL SELECT feature, threshold, false, {half_up("(s - s1) / (n - n1)", 4)}, CAST(n - n1 AS BIGINT) FROM best
"""
