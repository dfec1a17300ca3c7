"""Text, amounts, dates and frames: what each function gives over a table, held against SQL of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, money, text
from ..operators import keyed
from ..sources import tables
from .registry import Tables, query
from .views import NOW, now


def _pick(key: str, *values: object) -> Column:
    """One of the values by the remainder of a key."""
    out = F.lit(values[-1]) if not isinstance(values[-1], Column) else values[-1]
    for i, v in enumerate(values[:-1]):
        out = F.when(F.col(key) % len(values) == i, v if isinstance(v, Column) else F.lit(v)).otherwise(out)
    return out


def _case(key: str, *values: str) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


_ODD_NAMES = ("Ñandú 3025", "Łódź ő", "Ray-Bán □ ×", "FT1234S", "ft0001s")
_FOLD = r"regexp_replace(strip_accents(translate({}, '□×', 'xx')), '[^\x00-\x7F]', '', 'g')"


@query(
    "F3_identity_keys",
    f"""WITH n AS (SELECT p_partkey, {_case('p_partkey', *(f"'{x}'" for x in _ODD_NAMES))} AS odd, p_name FROM part), f AS (SELECT *, upper({_FOLD.format("odd")}) AS up, upper({_FOLD.format("p_name || ' ' || odd")}) AS long FROM n), k AS (SELECT *, regexp_replace(up, '[^A-Z0-9]', '', 'g') AS key FROM f)
SELECT p_partkey, key, CASE WHEN regexp_matches(key, '^FT[0-9]{{4}}S$') THEN substr(key, 1, 6) ELSE key END AS model, array_to_string(regexp_extract_all(long, '[A-Z0-9]+'), ' ') AS words FROM k""",
)
def _identity_keys(t: Tables) -> DataFrame:
    """F3, F4, F5."""
    rows = t.part.withColumn("odd", _pick("p_partkey", *_ODD_NAMES))
    return rows.select("p_partkey", text.identity_key(F.col("odd")).alias("key"), text.model_key(F.col("odd")).alias("model"), F.array_join(text.tokens(F.concat_ws(" ", "p_name", "odd")), " ").alias("words"))


@query(
    "F6_code_keys",
    f"""WITH c AS (SELECT p_partkey, {_case('p_partkey', "lpad(CAST(p_partkey AS VARCHAR), 8, '0')", "CAST(p_partkey AS VARCHAR)", "'000001234567890' || CAST(p_partkey AS VARCHAR)", "'x' || CAST(p_partkey AS VARCHAR)", "'000'")} AS code FROM part), s AS (SELECT *, coalesce(nullif(ltrim(code, '0'), ''), '0') AS bare FROM c)
SELECT p_partkey, code, CASE WHEN regexp_matches(code, '^[0-9]+$') THEN lpad(bare, CAST(greatest(14, length(bare)) AS INTEGER), '0') END AS key FROM s""",
)
def _code_keys(t: Tables) -> DataFrame:
    """codes of more than fourteen digits stay whole."""
    own = F.col("p_partkey").cast("string")
    rows = t.part.select("p_partkey", _pick("p_partkey", F.lpad(own, 8, "0"), own, F.concat(F.lit("000001234567890"), own), F.concat(F.lit("x"), own), "000").alias("code"))
    return rows.withColumn("key", text.zero_padded(F.col("code")))


@query(
    "F16_name_spans",
    """WITH w AS (SELECT p_partkey, regexp_extract_all(upper(p_name), '[A-Z0-9]+') AS w FROM part), s AS (SELECT p_partkey, list_distinct(flatten(list_transform([1, 2, 3, 4], lambda k: list_transform(range(1, greatest(len(w) - k + 2, 1)), lambda i: array_to_string(list_slice(w, i, i + k - 1), ''))))) AS s FROM w)
SELECT p_partkey, array_to_string(list_sort(s), ',') AS spans, len(list_intersect(s, ['REDBOLT', 'BLUERING', 'LARGE', 'WIDGET'])) > 0 AS linked FROM s""",
)
def _spans(t: Tables) -> DataFrame:
    """F16: a link matches if one of its keys is a contiguous group of a name's words."""
    rows = t.part.select("p_partkey", text.spans(text.tokens(F.col("p_name"))).alias("s"))
    return rows.select("p_partkey", F.array_join(F.array_sort("s"), ",").alias("spans"), text.link_matches(F.col("s"), ["REDBOLT", "BLUERING", "LARGE", "WIDGET"]).alias("linked"))


@query(
    "F18_technical_values",
    f"""WITH v AS (SELECT p_partkey, {_case('p_partkey', "' N/A '", "'photo_1.JPG'", "'ref 12345678'", "p_name", "''", "NULL", "'ab1234567'")} AS value FROM part), n AS (SELECT *, lower(trim(coalesce(value, ''))) AS low FROM v)
SELECT p_partkey, value, low IN ('', '-', 'n/a', 'none', 'null', 'unknown') OR regexp_matches(low, '\\.(jpg|jpeg|png|webp|tif|tiff)$') OR regexp_matches(low, '[0-9]{{8}}') AS technical FROM n""",
)
def _technical(t: Tables) -> DataFrame:
    rows = t.part.select("p_partkey", _pick("p_partkey", " N/A ", "photo_1.JPG", "ref 12345678", F.col("p_name"), "", F.lit(None).cast("string"), "ab1234567").alias("value"))
    return rows.withColumn("technical", text.is_technical(F.col("value")))


@query(
    "F19_escaped_cells",
    """SELECT p_partkey, '<td>' || replace(replace(replace(replace(replace(p_name || ' <b> & "' || p_brand || '" ''x''', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</td>' AS cell FROM part""",
)
def _escaped(t: Tables) -> DataFrame:
    raw = F.concat(F.col("p_name"), F.lit(' <b> & "'), F.col("p_brand"), F.lit("\" 'x'"))
    return t.part.select("p_partkey", F.concat(F.lit("<td>"), text.html_escape(raw), F.lit("</td>")).alias("cell"))


@query(
    "M2_amounts",
    f"""WITH a AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DECIMAL(18,2)) AS VARCHAR) AS plain FROM part), v AS (SELECT p_partkey, {_case('p_partkey', "CAST(plain AS DECIMAL(38,6))", "CAST(plain AS DECIMAL(38,6))", "NULL", "NULL", "CAST('-3' AS DECIMAL(38,6))", "CAST('0.125' AS DECIMAL(38,6))")} AS amount FROM a)
SELECT p_partkey, amount, CASE WHEN CAST(amount * 1000 AS BIGINT) % 10 <> 0 THEN CAST(CAST(amount AS DECIMAL(18,3)) AS VARCHAR) ELSE CAST(CAST(amount AS DECIMAL(18,2)) AS VARCHAR) END AS spelled FROM v""",
)
def _amounts(t: Tables) -> DataFrame:
    """M2, M3: a comma is the decimal sign, thousands separators and words are refused; two decimals at least."""
    plain = F.col("p_retailprice").cast("decimal(18,2)").cast("string")
    amount = money.money(_pick("p_partkey", F.replace(plain, F.lit("."), F.lit(",")), F.concat(F.lit(" +"), plain), "1.234,5", "x", " -3 ", "0,125"))
    return t.part.select("p_partkey", amount.alias("amount"), money.decimal_text(amount).alias("spelled"))


@query("M6_effective_prices", "SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice * 0.9 END, o_totalprice) * CASE WHEN o_orderkey % 2 = 0 THEN 1.0 WHEN o_orderkey % 5 > 0 THEN 0.5 END AS eur FROM orders")
def _effective(t: Tables) -> DataFrame:
    """M6: the promotional price, if there is one, in euros; no rate, no price."""
    fx = F.when(F.col("o_orderkey") % 2 == 0, 1.0).when(F.col("o_orderkey") % 5 > 0, 0.5)
    return t.orders.select("o_orderkey", money.effective_eur(F.col("o_totalprice"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice") * 0.9), fx).alias("eur"))


@query("M7_vat_rates", f"SELECT p_partkey, CAST({_case('p_partkey', '21', '10', '4', 'NULL', 'NULL', 'NULL', '21')} AS INTEGER) AS vat FROM part")
def _vat(t: Tables) -> DataFrame:
    """M7: ratios of 1.21, 1.10, 1.04, none, no price before tax, zero, and one that is 0.2 % off."""
    price = F.col("p_retailprice")
    return t.part.select("p_partkey", money.infer_vat(price * _pick("p_partkey", 1.21, 1.1, 1.04, 1.15, 1.21, 1.21, 1.2125), _pick("p_partkey", price, price, price, price, F.lit(None).cast("double"), 0.0, price)).alias("vat"))


@query("M9_backoffs", "SELECT p_partkey, CAST(least(60 * pow(2, p_size % 12), 3600) AS INTEGER) AS wait FROM part")
def _backoffs(t: Tables) -> DataFrame:
    """M9, R10."""
    return t.part.select("p_partkey", money.backoff_seconds(F.col("p_size") % 12).alias("wait"))


@query(
    "D1_iso_times",
    f"SELECT event_id, {_case('event_id', 's', 's - INTERVAL 2 HOUR', 'NULL', 's', 'NULL')} AS at FROM (SELECT event_id, date_trunc('second', ts) AS s FROM events)",
)
def _iso(t: Tables) -> DataFrame:
    """Zones are shifted to UTC, what is no time is NULL."""
    day, clock = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    told = _pick("event_id", F.concat(day, F.lit("T"), clock, F.lit("Z")), F.concat(day, F.lit("T"), clock, F.lit("+02:00")), "ayer", F.concat(day, F.lit(" "), clock), F.lit(None).cast("string"))
    return t.events.select("event_id", dates.iso_datetime(told).cast("timestamp_ntz").alias("at"))


@query("D2_written_dates", f"SELECT event_id, {_case('event_id', 'CAST(ts AS DATE)', 'CAST(ts AS DATE)', 'CAST(ts AS DATE)', 'NULL')} AS day FROM events")
def _written(t: Tables) -> DataFrame:
    """The date as written, whatever the zone behind it."""
    told = _pick("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T23:30:00-05:00")), F.concat(F.date_format("ts", "dd/MM/yyyy"), F.lit(" 10:00:00")), F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd"), F.lit(" CET")), "2024-13-45")
    return t.events.select("event_id", dates.written_date(told).alias("day"))


_LAST_SUNDAY = "({0} - CAST(isodow({0}) % 7 AS INTEGER))"
_FIRST = _LAST_SUNDAY.format("make_date(year(d), 3, 31)")
_LAST = _LAST_SUNDAY.format("CASE WHEN year(d) < 1996 THEN make_date(year(d), 9, 30) ELSE make_date(year(d), 10, 31) END")
_SHIFT = f"CASE WHEN {{0}} > {_FIRST} AND {{0}} <= {_LAST} THEN INTERVAL 2 HOUR ELSE INTERVAL 1 HOUR END"


@query("D6_day_bounds", f"WITH o AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT d AS day, CAST(d AS TIMESTAMP) - {_SHIFT.format('d')} AS starts, CAST(d + 1 AS TIMESTAMP) - {_SHIFT.format('CAST(d + 1 AS DATE)')} AS ends FROM o")
def _bounds(t: Tables) -> DataFrame:
    """Days of Madrid in UTC; the SQL has the summer time rule spelled out."""
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    start, end = dates.day_bounds_utc(F.col("day"))
    return days.select("day", start.cast("timestamp_ntz").alias("starts"), end.cast("timestamp_ntz").alias("ends"))


@query(
    "D8_check_times",
    f"WITH o AS (SELECT o_orderkey, o_orderdate AS captured, CASE WHEN o_orderkey % 6 < 5 THEN o_orderdate + (o_orderkey % 6 - 2) * INTERVAL 400 DAY END AS last_ok FROM orders) SELECT o_orderkey, CASE WHEN last_ok >= captured AND last_ok <= TIMESTAMP '{NOW}' THEN last_ok ELSE captured END AS checked_at FROM o",
)
def _checked(t: Tables) -> DataFrame:
    """Checks before the capture or in the future don't count."""
    days = (F.col("o_orderkey") % 6 - 2) * 400
    last_ok = F.when(F.col("o_orderkey") % 6 < 5, F.col("o_orderdate") + F.make_dt_interval(days.cast("int")))
    return t.orders.select("o_orderkey", dates.check_time(F.col("o_orderdate"), last_ok, now()).alias("checked_at"))


@query(
    "D9_scheduler_states",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'never' WHEN o_orderkey % 7 = 0 THEN 'stopped' WHEN o_orderkey % 2000 > 900 THEN 'stale' ELSE 'running' END AS state FROM orders",
)
def _scheduler(t: Tables) -> DataFrame:
    beat = F.when(F.col("o_orderkey") % 4 > 0, now() - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 2000).cast("decimal(18,6)")))
    return t.orders.select("o_orderkey", dates.scheduler_state(beat, F.col("o_orderkey") % 7 == 0, now()).alias("state"))


# --- frames ------------------------------------------------------------------


@query("P1_ordered_columns", "SELECT p_partkey AS codigo, p_name AS nombre, 'sin color' AS color, p_size FROM part")
def _ordered(t: Tables) -> DataFrame:
    """Canonical names first, a missing optional column as its default, others behind."""
    raw = t.part.select("p_size", F.col("p_name").alias(" Modelo "), F.col("p_partkey").alias("CODE"))
    return tables.canonicalize(raw, {"codigo": ["code"], "nombre": ["modelo"], "color": ["colour"]}, ["codigo"], {"color": "sin color"})


@query(
    "P6_coerced_frame",
    f"SELECT p_partkey, CAST({_case('p_partkey', '12.5', '0', '0', '0', '-3')} AS DOUBLE) AS price, {_case('p_partkey', '0', 'p_size', '0')}::DOUBLE AS stock, {_case('p_partkey', 'DATE 2024-01-31', 'NULL', 'NULL')} AS restocked FROM part".replace("DATE 2024-01-31", "TIMESTAMP '2024-01-31 00:00:00'"),
)
def _coerced(t: Tables) -> DataFrame:
    """Every number and date of a frame; what is none is zero or NULL."""
    raw = t.part.select(
        "p_partkey", _pick("p_partkey", "12.5", "abc", "", F.lit(None).cast("string"), " -3 ").alias("price"), _pick("p_partkey", "NaN", F.col("p_size").cast("string"), "1,5").alias("stock"),
        _pick("p_partkey", "2024-01-31", "31/01/24x", F.lit(None).cast("string")).alias("restocked"),
    )
    out = tables.coerce(raw, numbers=["price", "stock"], times=["restocked"])
    return out.withColumn("restocked", F.col("restocked").cast("timestamp_ntz"))


@query("P19_complete_products", "SELECT p_partkey FROM part WHERE p_partkey % 5 NOT IN (0, 1)")
def _complete(t: Tables) -> DataFrame:
    """Brand, model and colour are all there and not blank."""
    rows = t.part.select("p_partkey", _pick("p_partkey", "  ", F.col("p_brand"), F.col("p_brand"), F.col("p_brand"), F.col("p_brand")).alias("brand"), "p_name", F.when(F.col("p_partkey") % 5 != 1, F.col("p_type")).alias("colour"))
    return rows.where(text.complete("brand", "p_name", "colour")).select("p_partkey")


@query(
    "J13_inner_concat",
    """WITH a AS (SELECT p_brand AS brand, CAST(count(*) AS BIGINT) AS small FROM part WHERE p_size < 10 GROUP BY 1), b AS (SELECT p_brand AS brand, max(p_retailprice) AS most FROM part WHERE p_type = 'PROMO' GROUP BY 1), c AS (SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS stock FROM part WHERE p_size > 45 GROUP BY 1)
SELECT a.brand, small, most, stock FROM a JOIN b ON a.brand = b.brand JOIN c ON a.brand = c.brand""",
)
def _concat(t: Tables) -> DataFrame:
    brand = F.col("p_brand").alias("brand")
    small = t.part.where("p_size < 10").groupBy(brand).agg(F.count("*").alias("small"))
    most = t.part.where("p_type = 'PROMO'").groupBy(brand).agg(F.max("p_retailprice").alias("most"))
    stock = t.part.where("p_size > 45").groupBy(brand).agg(F.sum("p_size").alias("stock"))
    return keyed.inner_concat([small, most, stock], "brand")


@query(
    "N3_localised_names",
    f"SELECT p_partkey, {_case('p_partkey', 'p_name', 'p_brand', 'p_type', chr(39) + 'solo texto' + chr(39), 'NULL')} AS name FROM part",
)
def _localised(t: Tables) -> DataFrame:
    """Spanish, else English, else the text as it is."""
    js = lambda **kv: F.to_json(F.struct(*[v.alias(k) for k, v in kv.items()]))
    told = _pick("p_partkey", js(en_US=F.col("p_brand"), es_ES=F.col("p_name")), js(en_US=F.col("p_brand"), fr_FR=F.col("p_name")), F.col("p_type"), "solo texto", F.lit(None).cast("string"))
    return t.part.select("p_partkey", text.localised(told).alias("name"))


@query(
    "N7_outcome_export",
    """SELECT l_orderkey AS order_id, string_agg(CAST(l_partkey AS VARCHAR), ', ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS parts,
  '[' || string_agg('{"line":' || CAST(l_linenumber AS VARCHAR) || ',"part":' || CAST(l_partkey AS VARCHAR) || ',"supplier":' || CAST(l_suppkey AS VARCHAR) || ',"outcome":"' || l_returnflag || '"}', ',' ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) || ']' AS outcomes FROM lineitem GROUP BY l_orderkey""",
)
def _outcomes(t: Tables) -> DataFrame:
    """A list as text, and the nested outcomes as JSON."""
    one = F.struct(F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_returnflag").alias("outcome"))
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("order_id")).agg(F.array_sort(F.collect_list(one)).alias("x"))
    return rows.select("order_id", F.array_join(F.transform("x", lambda r: r["part"].cast("string")), ", ").alias("parts"), F.to_json("x").alias("outcomes"))
