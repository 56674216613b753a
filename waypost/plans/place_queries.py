"""One query for each operator, or tight group of operators, of the place library."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.functions import clean as C
from waypost.functions import display as D
from waypost.functions import normalize as N
from waypost.functions import predicates as P
from waypost.functions.geo import distance_label, haversine
from waypost.operators import batching, curation, enrich, geo, quality, search
from waypost.plans import oracle as O
from waypost.plans.catalog import register
from waypost.sources import clients, osm, osm_source
from waypost.sources.places import gazetteer, places
from waypost.sources.scratch import scratch

HOME = (52.3, 5.3)


def col(name: str):
    return F.col(name)


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/pages.parquet")


def projected(
    name: str, spark_columns: dict, sql_columns: dict[str, str], where=None, sql_where: str = "", key: str = "place_id"
) -> None:
    """A query that only projects, and maybe filters, the places."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        df = places(spark, d)
        df = df if where is None else df.filter(where())
        return df.select(key, *[v().alias(k) for k, v in spark_columns.items()])

    select = ", ".join([key, *[f"{v} AS {k}" for k, v in sql_columns.items()]])
    register(name, O.places(select, f"WHERE {sql_where}" if sql_where else ""))(query)


@register(
    "landing_stats",
    O.places(
        f"count(*) AS total, count(*) FILTER (WHERE {O.says('prijs', 'gratis')}) AS gratis, count(DISTINCT provincie) AS provincies"
    )
)
def landing_stats(spark: SparkSession, d: str) -> DataFrame:
    return quality.landing_stats(places(spark, d))


projected(
    "clean_values",
    {
        "naam": lambda: C.clean(col("naam")), "provincie": lambda: C.clean(col("provincie"), "?"),
        "prijs": lambda: C.clean(col("prijs"), "")
    },
    {"naam": O.clean("naam"), "provincie": O.clean("provincie", "?"), "prijs": O.clean("prijs", "")}
)
projected(
    "safe_floats",
    {"latitude": lambda: C.safe_float(col("latitude")), "beoordeling": lambda: C.safe_float(col("beoordeling"), -1.0)},
    {"latitude": f"coalesce({O.number('latitude')}, 0.0)", "beoordeling": f"coalesce({O.number('beoordeling')}, -1.0)"}
)
projected(
    "is_ja_flags", {c: lambda c=c: C.is_yes(col(c)) for c in ("honden_toegestaan", "stroom", "wifi")},
    {c: O.yes(c) for c in ("honden_toegestaan", "stroom", "wifi")}
)


@register(
    "html_escape",
    "SELECT doc_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM documents"
)
def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", C.escape_html(col("text")).alias("escaped"))


@register(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) <= 120 THEN text ELSE regexp_replace(substr(text, 1, 120), ' [^ ]*$', '') || '…' END AS short FROM documents"
)
def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", C.truncate(col("text")).alias("short"))


_LABEL = "CASE WHEN s >= 9 THEN 'Uitzonderlijk' WHEN s >= 8.5 THEN 'Geweldig' WHEN s >= 8 THEN 'Heel goed' WHEN s >= 7.5 THEN 'Goed' WHEN s >= 7 THEN 'Prima' ELSE 'Redelijk' END"
_SCORED = f", scored AS (SELECT place_id, {O.score('beoordeling')} AS s FROM places)"


@register("score_parse", O.places(f"place_id, {O.score('beoordeling')} AS score"))
def score_parse(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).select("place_id", C.parse_score(col("beoordeling")).alias("score"))


@register(
    "score_label",
    O.places(f"place_id, {_LABEL} AS label", "JOIN scored USING (place_id) WHERE s IS NOT NULL AND s <> 0", _SCORED)
)
def score_label(spark: SparkSession, d: str) -> DataFrame:
    shown = places(spark, d).select(
        "place_id", C.visible_score(C.parse_score(col("beoordeling"))).alias("s")
    ).filter("s is not null")
    return shown.select("place_id", C.score_label(col("s")).alias("label"))


_HEAD = O.number(f"split_part({O.clean('beoordeling', '')}, '/', 1)")
projected(
    "score_format", {"shown": lambda: C.format_score(col("beoordeling"))},
    {
        "shown": f"CASE WHEN ({O.clean('beoordeling', '')}) = '' THEN '' WHEN ({_HEAD}) IS NULL OR contains({O.clean('beoordeling', '')}, '/') THEN {O.clean('beoordeling', '')} ELSE ({O.clean('beoordeling', '')}) || '/5' END"
    }
)
projected(
    "score_visible", {"score": lambda: C.visible_score(C.parse_score(col("beoordeling")))},
    {"score": f"nullif({O.score('beoordeling')}, 0)"}
)
projected(
    "score_precedence",
    {
        "score": lambda: C.score_source(col("drukte_indicator"), col("beoordeling")),
        "other": lambda: C.score_source(F.when(col("place_id") % 2 == 0, ""), col("beoordeling"))
    },
    {"score": "coalesce(nullif(drukte_indicator, ''), beoordeling)", "other": "beoordeling"}
)
projected(
    "describe_precedence", {"text": lambda: D.first_of(F.when(col("place_id") % 2 == 0, ""), col("naam"), F.lit("-"))},
    {"text": "coalesce(nullif(naam, ''), '-')"}
)
projected(
    "vehicle_length", {"m": lambda: C.metres(col("max_lengte"))}, {"m": O.metres("max_lengte")}, P.long_vehicle,
    f"({O.metres('max_lengte')}) >= 8.0"
)
projected(
    "vehicle_weight", {"t": lambda: C.tons(col("max_gewicht"))}, {"t": O.tons("max_gewicht")}, P.heavy_vehicle,
    f"({O.tons('max_gewicht')}) >= 3.5"
)
projected(
    "coordinates", {"lat": lambda: C.number(col("latitude")), "lon": lambda: C.number(col("longitude"))},
    {"lat": O.number("latitude"), "lon": O.number("longitude")},
    lambda: C.number(col("latitude")).isNotNull() & C.number(col("longitude")).isNotNull(),
    f"({O.number('latitude')}) IS NOT NULL AND ({O.number('longitude')}) IS NOT NULL"
)
projected(
    "route_urls",
    {
        "url": lambda: C.route_url(
            F.replace(col("latitude"), F.lit(","), F.lit(".")), F.replace(col("longitude"), F.lit(","), F.lit("."))
        )
    },
    {
        "url": "'https://www.google.com/maps/dir/?api=1&destination=' || replace(latitude, ',', '.') || ',' || replace(longitude, ',', '.')"
    }
)


@register(
    "website_urls",
    "SELECT page_id, u AS given, CASE WHEN u LIKE 'http%' THEN u ELSE 'https://' || u END AS url FROM (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?://', '') END AS u FROM pages)"
)
def website_urls(spark: SparkSession, d: str) -> DataFrame:
    given = F.when(col("page_id") % 2 == 0, col("url")).otherwise(F.regexp_replace("url", "^https?://", ""))
    return pages(spark, d).select("page_id", given.alias("given")).withColumn("url", C.website(col("given")))


projected(
    "normalize_province", {"provincie": lambda: N.province(col("provincie"))}, {"provincie": O.province("provincie")}
)
projected(
    "normalize_phone", {"telefoonnummer": lambda: N.phone(col("telefoonnummer"))},
    {"telefoonnummer": O.phone("telefoonnummer")}
)


@register(
    "postprocess_rows",
    O.places(
        f"place_id, stroom, {O.province('provincie')} AS provincie, {O.phone('telefoonnummer')} AS telefoonnummer, CASE WHEN lower(stroom) = 'nee' THEN 'Nee (geen stroom)' END AS stroom_prijs, 'a, b' AS extra"
    )
)
def postprocess_rows(spark: SparkSession, d: str) -> DataFrame:
    return N.postprocess(
        places(spark, d).select(
            "place_id", "stroom", "provincie", "telefoonnummer", F.array(F.lit("a"), F.lit("b")).alias("extra")
        )
    )


def _filter(name: str, wanted: dict, sql: str) -> None:
    @register(name, O.places("place_id, naam", f"WHERE {sql}"))
    def query(spark: SparkSession, d: str) -> DataFrame:
        df = places(spark, d)
        condition, _ = P.extracted(df.columns, wanted)
        return df.filter(condition).select("place_id", "naam")


_filter("filter_province", {"provincie": "holland"}, O.says("provincie", "holland"))
_filter("filter_dogs", {"honden_toegestaan": "Ja"}, O.says("honden_toegestaan", "ja"))
_filter("filter_free", {"is_gratis": True}, O.says("prijs", "gratis"))
_filter("filter_power", {"stroom": "Nee"}, O.says("stroom", "nee"))
_filter("filter_water", {"water": "Ja"}, f"({O.says('waterfront', 'ja')} OR {O.says('water_tanken', 'ja')})")
_filter("filter_sanitary", {"sanitair": "Ja"}, O.says("sanitair", "ja"))
_filter("filter_wifi", {"wifi": "Ja"}, O.says("wifi", "ja"))
_filter(
    "filter_all", {"provincie": "land", "honden_toegestaan": "Ja", "stroom": "Ja", "is_gratis": True, "water": "Nee"},
    f"{O.says('provincie', 'land')} AND {O.says('honden_toegestaan', 'ja')} AND {O.says('stroom', 'ja')} AND {O.says('prijs', 'gratis')}"
)

projected(
    "free_definitions",
    {
        "says_free": lambda: P.free(), "is_free": lambda: F.lower(C.clean(col("prijs"), "")) == "gratis",
        "price_class": lambda: D.price_class(col("prijs")), "map_label": lambda: D.map_price(col("prijs"))
    },
    {
        "says_free": O.says("prijs", "gratis"), "is_free": f"lower({O.clean('prijs', '')}) = 'gratis'",
        "price_class": f"CASE WHEN lower({O.clean('prijs', '')}) = 'gratis' THEN 'gratis' WHEN ({O.clean('prijs', '')}) = '' THEN 'onbekend' ELSE 'betaald' END",
        "map_label": "CASE WHEN contains(lower(prijs), 'gratis') THEN 'Gratis' WHEN trim(prijs) <> '' AND lower(trim(prijs)) <> 'onbekend' THEN trim(prijs) ELSE '?' END"
    }
)


@register("unprocessed", O.places("place_id, ai_gecheckt", "WHERE ai_gecheckt <> 'Ja'"))
def unprocessed(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).filter(P.unprocessed()).select("place_id", "ai_gecheckt")


@register(
    "skip_unchanged",
    O.places("place_id", "WHERE place_id % 4 <> 0 AND lower(ai_gecheckt) = 'ja' AND ai_gecheckt <> 'Ja'")
)
def skip_unchanged(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).withColumn(
        "changed", col("place_id") % 4 == 0
    ).filter(P.unprocessed()).filter(P.unchanged()).select("place_id")


_SIX = ["stroom", "honden_toegestaan", "water_tanken", "waterfront", "sanitair", "wifi", "prijs", "provincie"]
_UNKNOWNS = " + ".join(f"(lower(trim({c})) = 'onbekend')::INT" for c in _SIX)


@register(
    "needs_fallback",
    O.places(f"place_id, {_UNKNOWNS} AS unknowns, (place_id % 500 < 250 OR {_UNKNOWNS} > 4) AS fallback")
)
def needs_fallback(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).withColumn("total_len", col("place_id") % 500).select(
        "place_id", P.unknowns(_SIX).alias("unknowns"), P.needs_fallback(_SIX).alias("fallback")
    )


@register(
    "map_rows",
    O.places(
        "place_id, naam, provincie, CASE WHEN contains(lower(prijs), 'gratis') THEN 'Gratis' WHEN trim(prijs) <> '' AND lower(trim(prijs)) <> 'onbekend' THEN trim(prijs) ELSE '?' END AS label",
        "WHERE latitude IS NOT NULL AND longitude IS NOT NULL ORDER BY place_id LIMIT 300"
    )
)
def map_rows(spark: SparkSession, d: str) -> DataFrame:
    """The map's limit is the feature (O2)."""
    return places(spark, d).na.drop(subset=["latitude", "longitude"]).orderBy("place_id").limit(300).select(
        "place_id", "naam", "provincie", D.map_price(col("prijs")).alias("label")
    )


@register("province_options", O.places("DISTINCT provincie", "WHERE lower(provincie) NOT IN ('onbekend', '', 'nan')"))
def province_options(spark: SparkSession, d: str) -> DataFrame:
    return quality.province_options(places(spark, d))


def _favourites(spark: SparkSession, d: str) -> DataFrame:
    return places(spark, d).filter("place_id % 10 = 3").select("naam")


@register(
    "favourites_semi", O.places("place_id, naam", "WHERE naam IN (SELECT naam FROM places WHERE place_id % 10 = 3)")
)
def favourites_semi(spark: SparkSession, d: str) -> DataFrame:
    return curation.favourites_of(places(spark, d), _favourites(spark, d)).select("place_id", "naam")


@register(
    "favourites_anti", O.places("place_id, naam", "WHERE naam NOT IN (SELECT naam FROM places WHERE place_id % 10 = 3)")
)
def favourites_anti(spark: SparkSession, d: str) -> DataFrame:
    return curation.others(places(spark, d), _favourites(spark, d)).select("place_id", "naam")


def _search(name: str, query: str) -> None:
    t = query.strip().lower()
    stage = f"CASE WHEN {O.says('naam', t)} THEN 1 WHEN {O.says('provincie', t)} THEN 2 END"

    @register(
        name,
        O.places(
            "place_id, best IS NULL AS use_ai",
            "JOIN staged USING (place_id) CROSS JOIN best WHERE best IS NULL OR stage = best",
            f", staged AS (SELECT place_id, {stage} AS stage FROM places), best AS (SELECT min(stage) AS best FROM staged)"
        )
    )
    def run(spark: SparkSession, d: str) -> DataFrame:
        return search.cascade(places(spark, d), query).select("place_id", "use_ai")


_search("search_name", " Jachthaven ")
_search("search_province", "Zeeland")
_search("search_none", "zxqj")


@register(
    "natural_query",
    O.places(
        "place_id",
        f"WHERE {O.says('prijs', 'gratis')} AND {O.says('honden_toegestaan', 'ja')} AND {O.says('provincie', 'drenthe')}"
    )
)
def natural_query(spark: SparkSession, d: str) -> DataFrame:
    return search.natural(places(spark, d), "gratis plek in Drenthe voor de hond")[0].select("place_id")


_NOISE = "CASE event_id % 5 WHEN 0 THEN 'Antwoord: ' || props || ' klaar' WHEN 1 THEN '```json' || chr(10) || props || chr(10) || '```' WHEN 2 THEN '[' || props || ',' || props || ']' WHEN 3 THEN '⚠️ ' || props ELSE 'niets' END"


@register(
    "extract_json",
    "SELECT event_id, CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '[' || props || ',' || props || ']' END AS json FROM events"
)
def extract_json(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{_NOISE} AS noisy").select(
        "event_id", search.first_json(col("noisy")).alias("json")
    )


@register(
    "geocode_query_text",
    "SELECT n_nationkey, CASE WHEN contains(lower(n_name), 'nederland') THEN n_name ELSE n_name || ', Nederland' END AS query FROM nation"
)
def geocode_query_text(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/nation.parquet").select(
        "n_nationkey", search.geocode_query(col("n_name")).alias("query")
    )


_KM = O.distance(*HOME)


@register(
    "haversine_distance",
    O.places(
        f"place_id, round({O.km('52.3', '5.3', f'({O.number("latitude")})', f'({O.number("longitude")})')}, 3) AS km",
        f"WHERE ({O.number('latitude')}) IS NOT NULL AND ({O.number('longitude')}) IS NOT NULL"
    )
)
def haversine_distance(spark: SparkSession, d: str) -> DataFrame:
    located = geo.with_coordinates(places(spark, d)).filter("lat_d is not null and lon_d is not null")
    return located.select(
        "place_id", F.round(haversine(F.lit(HOME[0]), F.lit(HOME[1]), col("lat_d"), col("lon_d")), 3).alias("km")
    )


@register(
    "distance_labels",
    O.places(
        f"place_id, CASE WHEN ({_KM}) < 9999 THEN CAST(round(round({_KM}, 3), 1) AS VARCHAR) || ' km' ELSE '?' END AS label"
    )
)
def distance_labels(spark: SparkSession, d: str) -> DataFrame:
    return geo.add_distances(places(spark, d), *HOME).select(
        "place_id", distance_label(F.round("afstand_km", 3)).alias("label")
    )


@register("radius_filter", O.places(f"place_id, round({_KM}, 3) AS km", f"WHERE ({_KM}) <= 60"))
def radius_filter(spark: SparkSession, d: str) -> DataFrame:
    return geo.within(places(spark, d), HOME, 60.0).select("place_id", F.round("afstand_km", 3).alias("km"))


@register(
    "nearest_k", O.places(f"place_id, round({_KM}, 3) AS km, row_number() OVER (ORDER BY {_KM}, place_id) AS rank")
)
def nearest_k(spark: SparkSession, d: str) -> DataFrame:
    """O1: all places by distance; ``geo.nearest`` gives the first k."""
    near = search.ordered(geo.add_distances(places(spark, d), *HOME), "distance")
    return near.select("place_id", F.round("afstand_km", 3).alias("km"), "rank")


@register(
    "map_centroid",
    O.places(
        f"round(coalesce(avg({O.number('latitude')}), 52.3), 6) AS lat, round(coalesce(avg({O.number('longitude')}), 5.3), 6) AS lon, CASE WHEN count(*) = 0 THEN 7 WHEN count(*) > 15 THEN 8 ELSE 11 END AS zoom, least(count(*), 300) AS shown"
    )
)
def map_centroid(spark: SparkSession, d: str) -> DataFrame:
    return geo.centroid(places(spark, d)).select(
        F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "zoom", "shown"
    )


_LOCATED = f", located AS (SELECT place_id, {O.number('latitude')} AS la, {O.number('longitude')} AS lo FROM places), near AS (SELECT place_id, arg_min(city_id, (round({O.km('la', 'lo', 'lat', 'lon')}, 6), city_id)) AS city_id FROM located, gazetteer WHERE la IS NOT NULL AND lo IS NOT NULL GROUP BY place_id)"


@register(
    "nearest_gazetteer",
    O.places(
        "place_id, city_id, cc, admin1", "JOIN near USING (place_id) JOIN gazetteer USING (city_id)",
        O.GAZETTEER + _LOCATED
    )
)
def nearest_gazetteer(spark: SparkSession, d: str) -> DataFrame:
    return geo.nearest_city(geo.with_coordinates(places(spark, d)), gazetteer(spark, d))


@register(
    "nl_only",
    O.places(
        "place_id, naam, admin1 AS provincie",
        "JOIN near USING (place_id) JOIN gazetteer USING (city_id) WHERE cc = 'NL'", O.GAZETTEER + _LOCATED
    )
)
def nl_only(spark: SparkSession, d: str) -> DataFrame:
    return geo.in_country(places(spark, d), gazetteer(spark, d)).select("place_id", "naam", "provincie")


_ELEMENT = """'{"elements":[{"type":"node"' || CASE WHEN place_id % 3 = 0 THEN ',"center":{"lat":' || la || ',"lon":' || lo || '}' ELSE ',"lat":' || la || ',"lon":' || lo END || ',"tags":{' || CASE WHEN place_id % 5 = 0 THEN '"addr:city":"Sneek"' ELSE '"name":"' || naam || '"' END || CASE WHEN place_id % 2 = 0 THEN ',"phone":"+31 6-12 34"' ELSE ',"contact:phone":"0 6"' END || ',"dog":"' || CASE WHEN place_id % 4 = 0 THEN 'yes' ELSE 'no' END || '","power_supply":"' || CASE WHEN place_id % 3 = 1 THEN 'yes' ELSE '' END || '"' || CASE WHEN place_id % 6 = 1 THEN ',"water_point":"yes","capacity":"12"' ELSE '' END || CASE place_id % 9 WHEN 2 THEN ',"website":"www.a.nl"' WHEN 3 THEN ',"contact:website":"http://b.nl"' ELSE '' END || ',"fee":"' || CASE WHEN place_id % 7 = 0 THEN 'no' ELSE 'yes' END || '"' || CASE WHEN place_id % 11 = 0 THEN ',"charge":"5 EUR"' ELSE '' END || '}}]}'"""
_WITH_JSON = f"SELECT place_id, naam, la, lo, {_ELEMENT} AS payload FROM (SELECT place_id, naam, CAST(51 + place_id % 2 AS STRING) || '.5' AS la, CASE WHEN place_id % 97 = 0 THEN '0.0' ELSE '5.25' END AS lo FROM places)"
_NAME = "CASE WHEN place_id % 5 = 0 THEN 'Camperplaats Sneek' ELSE naam END"


@register(
    "osm_ingest",
    O.places(
        f"place_id, {_NAME} AS naam, CAST(51 + place_id % 2 AS DOUBLE) + 0.5 AS latitude, 5.25::DOUBLE AS longitude, CASE WHEN place_id % 2 = 0 THEN '+3161234' ELSE '06' END AS telefoonnummer, CASE WHEN place_id % 4 = 0 THEN 'Ja' ELSE 'Onbekend' END AS honden_toegestaan, CASE WHEN place_id % 11 = 0 THEN '5 EUR' WHEN place_id % 7 = 0 THEN 'Gratis' ELSE 'Onbekend' END AS prijs, CASE WHEN place_id % 3 = 1 THEN 'Ja' ELSE 'Onbekend' END AS stroom, CASE WHEN place_id % 6 = 1 THEN 'Ja' ELSE 'Onbekend' END AS waterfront, CASE WHEN place_id % 6 = 1 THEN '12' ELSE 'Onbekend' END AS aantal_plekken, CASE place_id % 9 WHEN 2 THEN 'www.a.nl' WHEN 3 THEN 'http://b.nl' ELSE '' END AS website, {O.q(C.PLACEHOLDER_IMAGE)} AS afbeelding, 'Nee' AS ai_gecheckt, 'Onbekend' AS provincie",
        f"WHERE place_id % 97 <> 0 AND NOT regexp_matches(lower({_NAME}), 'hotel|appartement|bungalow|chalet|vakantiepark|resort|villa|studio')"
    )
)
def osm_ingest(spark: SparkSession, d: str) -> DataFrame:
    df = places(spark, d).selectExpr(
        "place_id", "naam", "CAST(51 + place_id % 2 AS STRING) || '.5' AS la",
        "CASE WHEN place_id % 97 = 0 THEN '0.0' ELSE '5.25' END AS lo"
    ).selectExpr("place_id", f"{_ELEMENT} AS payload")
    return osm.ingest(osm.elements(df, "payload", "place_id"), "place_id").select(
        "place_id", "naam", "latitude", "longitude", "telefoonnummer", "honden_toegestaan", "prijs", "stroom",
        "waterfront", "aantal_plekken", "website", "afbeelding", "ai_gecheckt", "provincie"
    )


_TAGS = """CASE place_id % 6 WHEN 0 THEN '"tourism":"caravan_site"' WHEN 1 THEN '"amenity":"parking","motorhome":"yes"' WHEN 2 THEN '"tourism":"camp_site","motorhome":"designated"' WHEN 3 THEN '"amenity":"parking","motorhome":"no"' WHEN 4 THEN '"tourism":"camp_site"' ELSE '"tourism":"hotel"' END"""
_KIND = "CASE place_id % 5 WHEN 0 THEN 'relation' WHEN 1 THEN 'way' ELSE 'node' END"
_FOUND = f"""'{{"elements":[{{"type":"' || {_KIND} || '","center":{{"lat":' || CASE WHEN place_id % 4 = 0 THEN '60.5' ELSE '52.5' END || ',"lon":' || CASE WHEN place_id % 11 = 0 THEN '2.5' ELSE '5.5' END || '}},"tags":{{' || {_TAGS} || '}}}}]}}'"""


@register(
    "osm_search",
    O.places(
        "place_id",
        "WHERE (place_id % 6 IN (0, 2) OR (place_id % 6 = 1 AND place_id % 5 <> 0)) AND place_id % 4 <> 0 AND place_id % 11 <> 0"
    )
)
def osm_search(spark: SparkSession, d: str) -> DataFrame:
    payloads = places(spark, d).selectExpr("place_id", f"{_FOUND} AS payload")
    return osm.elements(payloads, "payload", "place_id").filter(osm.in_search()).select("place_id")


_FOUND_BY_ID = _FOUND.replace('"center":', '"id":\' || place_id || \',"center":')


@register(
    "osm_source_search",
    O.places(
        "place_id, CASE place_id % 6 WHEN 0 THEN 'caravan_site' WHEN 1 THEN 'parking' ELSE 'camp_site' END AS clause, 52.5::DOUBLE AS lat, 5.5::DOUBLE AS lon",
        "WHERE (place_id % 6 IN (0, 2) OR (place_id % 6 = 1 AND place_id % 5 <> 0)) AND place_id % 4 <> 0 AND place_id % 11 <> 0"
    )
)
def osm_source_search(spark: SparkSession, d: str) -> DataFrame:
    """Payload files of many elements, read in ranges by the data source, box and clauses decided in the parse."""
    path = scratch(spark, "payloads")
    places(spark, d).selectExpr("place_id", f"{_FOUND_BY_ID} AS payload").select("payload").write.text(path)
    return osm_source.search(spark, path, split_bytes=1 << 20).select(col("id").alias("place_id"), "clause", "lat", "lon")


@register(
    "scrape_page_text",
    r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) AS text FROM pages"
)
def scrape_page_text(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", enrich.page_text(col("html")).alias("text"))


@register("scrape_title", "SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def scrape_title(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("page_id", enrich.title(col("html")).alias("title"))


@register("scrape_text_length", "SELECT page_id, (length(html) + length(url))::BIGINT AS total_len FROM pages")
def scrape_text_length(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(
        "page_id", enrich.text_length(col("html"), col("url"), F.lit(None).cast("string")).alias("total_len")
    )


@register("page_hash", "SELECT page_id, url, md5(html) AS hash, page_id % 3 <> 0 AS changed FROM pages")
def page_hash(spark: SparkSession, d: str) -> DataFrame:
    new = pages(spark, d).select(
        "page_id", F.concat("url", F.lit("#"), "page_id").alias("url"), F.md5("html").alias("hash")
    )
    known = new.select("url", F.when(col("page_id") % 3 == 0, col("hash")).otherwise(F.lit("old")).alias("hash"))
    return enrich.changed(new, known).select(
        "page_id", F.regexp_replace("url", "#[0-9]+$", "").alias("url"), "hash", "changed"
    )


@register(
    "fill_unknown_merge",
    O.places(
        "place_id, CASE WHEN lower(trim(stroom)) = 'onbekend' AND place_id % 2 = 0 THEN 'Ja' ELSE stroom END AS stroom, CASE WHEN lower(trim(wifi)) = 'onbekend' AND place_id % 4 = 0 THEN 'Nee' ELSE wifi END AS wifi"
    )
)
def fill_unknown_merge(spark: SparkSession, d: str) -> DataFrame:
    base = places(spark, d).select("place_id", "stroom", "wifi")
    updates = base.filter("place_id % 2 = 0").select(
        "place_id", F.lit("Ja").alias("stroom"),
        F.when(col("place_id") % 4 == 0, "Nee").otherwise("onbekend").alias("wifi")
    )
    return enrich.fill_unknown(base, updates, ["stroom", "wifi"])


@register(
    "upsert_enrichment",
    O.places(
        "place_id, CASE WHEN place_id % 3 = 1 THEN 'nieuw' ELSE prijs END AS prijs, CASE WHEN place_id % 3 = 1 THEN 'stil' ELSE 'Onbekend' END AS rust, CASE WHEN place_id % 3 = 1 THEN 'Ja' ELSE ai_gecheckt END AS ai_gecheckt"
    )
)
def upsert_enrichment(spark: SparkSession, d: str) -> DataFrame:
    base = places(spark, d).select("place_id", "prijs", "ai_gecheckt")
    updates = base.filter("place_id % 3 = 1").select(
        "place_id", F.lit("nieuw").alias("prijs"), F.lit("stil").alias("rust")
    )
    return enrich.upsert(base, updates)


_POS = ", numbered AS (SELECT place_id, row_number() OVER (ORDER BY place_id) - 1 AS position FROM places)"


@register(
    "batches_of_five", O.places("place_id, position, position // 5 AS batch", "JOIN numbered USING (place_id)", _POS)
)
def batches_of_five(spark: SparkSession, d: str) -> DataFrame:
    return batching.numbered(places(spark, d).select("place_id")).select("place_id", "position", "batch")


@register(
    "positional_pairing",
    O.places(
        "place_id, position // 5 AS batch, CAST(position % 5 AS INT) AS pos, 'item' || (position % 5) AS item",
        "JOIN numbered USING (place_id) WHERE position % 5 < 4", _POS
    )
)
def positional_pairing(spark: SparkSession, d: str) -> DataFrame:
    inputs = batching.numbered(places(spark, d).select("place_id")).select(
        "place_id", "batch", (col("position") % 5).cast("int").alias("pos")
    )
    outputs = inputs.select("batch").distinct().withColumn("items", F.array(*[F.lit(f"item{i}") for i in range(4)]))
    return enrich.paired(inputs, outputs).select("place_id", "batch", "pos", "item")


_PROFILE = [c for c in quality.PROFILED if c not in ("beschrijving", "remote_work_score")]


@register(
    "unknown_profile",
    " UNION ALL ".join(
        O.places(
            f"{O.q(c)} AS veld, count(*) FILTER (WHERE lower({c}) = 'onbekend') AS onbekend, round(count(*) FILTER (WHERE lower({c}) = 'onbekend') / greatest(count(*), 1) * 100, 1) AS pct"
        ).join(["(", ")"])
        for c in _PROFILE
    )
)
def unknown_profile(spark: SparkSession, d: str) -> DataFrame:
    return quality.unknown_profile(places(spark, d))


@register(
    "batch_progress",
    O.places(
        "count(*) FILTER (WHERE ai_gecheckt = 'Ja') AS done, count(*) FILTER (WHERE ai_gecheckt <> 'Ja') AS todo, CAST(ceil(count(*) FILTER (WHERE ai_gecheckt <> 'Ja') / 5) AS BIGINT) AS batches"
    )
)
def batch_progress(spark: SparkSession, d: str) -> DataFrame:
    return quality.progress(places(spark, d))


@register(
    "run_counters",
    O.places(
        "count(*) AS processed, count(*) FILTER (WHERE place_id % 6 <> 0) AS succeeded, count(*) FILTER (WHERE place_id % 4 = 0) AS skipped, count(*) FILTER (WHERE place_id % 9 = 0) AS fallback, round(count(*) FILTER (WHERE place_id % 6 <> 0) / greatest(count(*), 1) * 100, 1) AS pct"
    )
)
def run_counters(spark: SparkSession, d: str) -> DataFrame:
    results = places(spark, d).select(
        F.when(col("place_id") % 6 != 0, col("naam")).alias("naam"), (col("place_id") % 4 == 0).alias("skipped"),
        (col("place_id") % 9 == 0).alias("fallback")
    )
    return quality.run_counters(results)


_SECONDS = "(place_id * 7 % 5000)"
_LEFT = f"((place_id + 10 - place_id) * ({_SECONDS}::DOUBLE / greatest(place_id, 1)))"


@register(
    "run_times",
    O.places(
        f"place_id, place_id::DOUBLE / (place_id + 10) * 100 AS pct, ({_SECONDS} // 60) || 'm ' || ({_SECONDS} % 60) || 's' AS elapsed, CASE WHEN place_id = 0 THEN '–' ELSE '~' || CAST(floor({_LEFT} / 60) AS BIGINT) || 'm ' || CAST(floor({_LEFT}) % 60 AS BIGINT) || 's' END AS eta"
    )
)
def run_times(spark: SparkSession, d: str) -> DataFrame:
    n = col("place_id")
    share, taken, left = quality.run_times(n, n + 10, n * 7 % 5000)
    return places(spark, d).select("place_id", share.alias("pct"), taken.alias("elapsed"), left.alias("eta"))


_MIN = "(p_partkey::DOUBLE / 10 * 3.0 / 60 + p_partkey::DOUBLE / 5 * (4.0 + 1.5) / 60)"


@register(
    "batch_time_estimate",
    f"SELECT p_partkey AS n, '~' || CAST(CAST(floor({_MIN}) AS BIGINT) AS VARCHAR) || ' – ' || CAST(CAST(floor({_MIN} * 1.4) AS BIGINT) AS VARCHAR) || ' minuten' AS label FROM part"
)
def batch_time_estimate(spark: SparkSession, d: str) -> DataFrame:
    n = col("n").cast("double")
    return places(spark, d).select(col("place_id").alias("n")).select("n", quality.minutes_label(n).alias("label"))


projected(
    "photo_pick", {"photo": lambda: D.photo(col("photos"), F.when(col("place_id") % 2 == 0, "img.jpg").otherwise("-"))},
    {
        "photo": f"CASE WHEN place_id % 4 = 0 THEN 'https://a/1.jpg' WHEN place_id % 2 = 0 THEN 'img.jpg' ELSE {O.q(C.PLACEHOLDER_IMAGE)} END"
    }
)
projected(
    "photo_extra", {"more": lambda: D.more_photos(col("photos"))[0], "n": lambda: D.more_photos(col("photos"))[1]},
    {
        "more": "CASE WHEN place_id % 4 = 0 THEN 'https://a/2.jpg' ELSE '' END",
        "n": "CASE WHEN place_id % 4 = 0 THEN 2 ELSE 0 END::BIGINT"
    }
)


@register(
    "prompt_clip",
    "SELECT page_id, coalesce(nullif(substr(html, 1, 2500), ''), '(niet beschikbaar)') AS site, '(niet gevonden)' AS review FROM pages"
)
def prompt_clip(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(
        "page_id", enrich.clipped(col("html"), enrich.SITE_CHARS, enrich.NO_SITE).alias("site"),
        enrich.clipped(F.lit(""), enrich.REVIEW_CHARS, enrich.NO_REVIEW).alias("review")
    )


#: Texts of the three sources, missing, short or longer than the prompt takes, in SQL that both engines read alike.
_SOURCES = {
    "site_text": "CASE place_id % 3 WHEN 0 THEN '' WHEN 1 THEN repeat('plek ', 20) ELSE repeat('lange tekst ', 300) END",
    "camper_text": "CASE place_id % 4 WHEN 0 THEN NULL WHEN 1 THEN repeat('goed ', 400) ELSE 'rustig, ' || provincie END",
    "park_text": "CASE place_id % 5 WHEN 0 THEN repeat('stil ', 301) WHEN 1 THEN '' ELSE naam END",
}
_CLIP = lambda c, n, none: f"coalesce(nullif(substr({c}, 1, {n}), ''), '{none}')"
_BLOCK = f"""'--- Plek ' || (position % 5 + 1) || ': ' || naam || ' (' || provincie || ') ---' || chr(10)
  || 'Website (' || (coalesce(length(site_text), 0) + coalesce(length(camper_text), 0) + coalesce(length(park_text), 0)) || ' tekens): ' || {_CLIP('site_text', 2500, '(niet beschikbaar)')} || chr(10)
  || 'Reviews 1: ' || {_CLIP('camper_text', 1500, '(niet gevonden)')} || chr(10) || 'Reviews 2: ' || {_CLIP('park_text', 1500, '(niet gevonden)')} || chr(10)"""
_DATA = """'Data: {"naam":' || to_json(naam) || ',"provincie":' || to_json(provincie) || ',"prijs":' || to_json(prijs) || '}'"""


@register(
    "prompt_payload",
    O.places(
        f"position // 5 AS batch, string_agg({_BLOCK}, chr(10) ORDER BY place_id) || chr(10) || string_agg({_DATA}, chr(10) ORDER BY place_id) AS prompt",
        "JOIN numbered USING (place_id) JOIN sourced USING (place_id) GROUP BY 1",
        _POS + f", sourced AS (SELECT place_id, {', '.join(f'{sql} AS {c}' for c, sql in _SOURCES.items())} FROM places)"
    )
)
def prompt_payload(spark: SparkSession, d: str) -> DataFrame:
    """The head of each place, three clipped sources with their length, and the data."""
    rows = places(spark, d).selectExpr("place_id", "naam", "provincie", "prijs", *[f"{sql} AS {c}" for c, sql in _SOURCES.items()])
    return enrich.prompts(batching.numbered(rows), ["naam", "provincie", "prijs"])


_DRUK = O.clean("drukte_indicator", "")
projected(
    "crowding_class", {"drukte": lambda: D.crowding(col("drukte_indicator"))},
    {
        "drukte": f"CASE WHEN ({_DRUK}) = '' THEN NULL WHEN contains(lower({_DRUK}), 'vol') THEN 'vol' WHEN contains(lower({_DRUK}), 'druk') THEN 'druk' WHEN regexp_matches(lower({_DRUK}), 'plek|vrij|ruim') THEN 'plek' ELSE {_DRUK} END"
    }
)


def _labels(pairs, *more: str) -> str:
    return "concat_ws(', ', " + ", ".join(
        [*[f"CASE WHEN {O.yes(c)} THEN {O.q(label)} END" for c, label in pairs], *more]
    ) + ")"


projected(
    "facility_chips", {"chips": D.chips},
    {
        "chips": _labels(
            D.CHIPS, f"CASE WHEN ({O.clean('max_lengte', '')}) <> '' THEN 'max ' || ({O.clean('max_lengte', '')}) END"
        )
    }
)
projected("facility_badges", {"badges": D.badges}, {"badges": _labels(D.BADGES)})
_HAVE = {
    "stroom", "wifi", "honden_toegestaan", "sanitair", "water_tanken", "afvalwater", "waterfront", "max_lengte",
    "max_gewicht", "drukte_indicator", "prijs", "telefoonnummer"
}


def _grid(pairs) -> str:
    state = lambda c: f"CASE WHEN lower({O.clean(c)}) IN ('ja', 'nee') THEN lower({O.clean(c)}) ELSE {O.clean(c)} END"
    return " || '; ' || ".join(
        f"'{label}=' || ({state(c)})" if c in _HAVE else f"'{label}=Onbekend'" for c, label in pairs
    )


projected("facility_grid", {"grid": lambda: D.grid(D.GRID, list(_HAVE))}, {"grid": _grid(D.GRID)})
projected("house_rules", {"rules": lambda: D.grid(D.RULES, list(_HAVE))}, {"rules": _grid(D.RULES)})
_REMOTE = "CASE place_id % 5 WHEN 0 THEN 'Uitstekend 5G' WHEN 1 THEN 'matig' WHEN 2 THEN '-' WHEN 3 THEN 'goed' ELSE 'wisselend' END"
projected(
    "remote_class", {"remote": lambda: D.remote_class(F.expr(_REMOTE))},
    {
        "remote": "CASE place_id % 5 WHEN 0 THEN 'good' WHEN 1 THEN 'poor' WHEN 2 THEN NULL WHEN 3 THEN 'good' ELSE 'info' END"
    }
)
projected(
    "result_cards",
    {
        "naam": lambda: C.clean(col("naam")), "provincie": lambda: N.province(col("provincie")),
        "score": lambda: C.visible_score(C.parse_score(col("beoordeling"))),
        "price_class": lambda: D.price_class(col("prijs")), "chips": D.chips
    },
    {
        "naam": O.clean("naam"), "provincie": O.province("provincie"), "score": f"nullif({O.score('beoordeling')}, 0)",
        "price_class": f"CASE WHEN lower({O.clean('prijs', '')}) = 'gratis' THEN 'gratis' WHEN ({O.clean('prijs', '')}) = '' THEN 'onbekend' ELSE 'betaald' END",
        "chips": _labels(
            D.CHIPS, f"CASE WHEN ({O.clean('max_lengte', '')}) <> '' THEN 'max ' || ({O.clean('max_lengte', '')}) END"
        )
    }
)


def _details(section: str, pairs, fallback=None) -> str:
    """SQL: a row for each (column, label) of a detail table."""
    own = lambda c, f: O.clean(c, f) if c in _HAVE else O.q(f)
    state = lambda c: f"CASE WHEN lower({O.clean(c)}) IN ('ja', 'nee') THEN lower({O.clean(c)}) ELSE {O.clean(c)} END"
    value = lambda c, label: own(c, label) if section == "texts" else state(c) if section in (
        "facilities", "rules"
    ) and c in _HAVE else own(c, "Onbekend")
    return " UNION ALL ".join(
        "(" + O.places(
            f"place_id, {O.q(section)} AS section, {O.q(c if section == 'texts' else label)} AS label, {value(c, label)} AS value"
        ) + ")" for c,
        label in pairs
    )


@register(
    "detail_rows",
    " UNION ALL ".join(
        _details(section, pairs) for section,
        pairs in (
            ("facts", D.FACTS), ("facilities", D.GRID), ("vehicle", D.DETAILS), ("rules", D.RULES), ("texts", D.TEXTS)
        )
    )
)
def detail_rows(spark: SparkSession, d: str) -> DataFrame:
    df = places(spark, d)
    return df.select("place_id", F.inline(D.details(df.columns)))


_POPUP = {
    "naam": O.escape(O.clean("naam")), "provincie": O.escape(O.clean("provincie", "")),
    "honden": O.yes("honden_toegestaan"), "stroom": O.yes("stroom"), "prijs": O.escape(O.clean("prijs", "?")),
    "free": f"contains(lower({O.clean('prijs', '?')}), 'gratis')"
}
projected("map_popup", {k: lambda k=k: D.popup()[k] for k in _POPUP}, _POPUP)


def _deduce(c: str, *whens: tuple[str, str]) -> str:
    return f"CASE WHEN lower(trim({c})) <> 'onbekend' THEN {c} " + " ".join(
        f"WHEN regexp_matches(lower(naam), '{p}') THEN '{v}'" for p, v in whens
    ) + f" ELSE {c} END"


@register(
    "deduction_rules",
    O.places(
        f"place_id, {_deduce('stroom', ('parking|parkeer', 'Nee'))} AS stroom, {_deduce('sanitair', ('parking|parkeer', 'Nee'), ('jachthaven|marina|camping|vakantiepark', 'Ja'))} AS sanitair, {_deduce('water_tanken', ('jachthaven|marina|camping|vakantiepark', 'Ja'))} AS water_tanken, {_deduce('afvalwater', ('jachthaven|marina', 'Ja'))} AS afvalwater"
    )
)
def deduction_rules(spark: SparkSession, d: str) -> DataFrame:
    return enrich.deduced(places(spark, d)).select("place_id", "stroom", "sanitair", "water_tanken", "afvalwater")


_TOLD = "CASE place_id % 4 WHEN 0 THEN '24u open' WHEN 1 THEN 'Honden welkom!' WHEN 2 THEN 'Altijd open, honden welkom' ELSE 'rustig' END"
_REVIEWS = "CASE place_id % 3 WHEN 0 THEN 'Muntjes douche' ELSE 'fijn' END"


@register(
    "deduction_texts",
    O.places(
        f"place_id, CASE WHEN place_id % 5 = 0 THEN '14:00' WHEN place_id % 4 IN (0, 2) THEN 'Vrij' ELSE 'Onbekend' END AS check_in_out, CASE WHEN lower(trim(honden_toegestaan)) = 'onbekend' AND place_id % 4 IN (1, 2) THEN 'Ja' ELSE honden_toegestaan END AS honden_toegestaan, CASE WHEN lower(trim(sanitair)) <> 'onbekend' THEN sanitair WHEN regexp_matches(lower(naam), 'parking|parkeer') THEN 'Nee' WHEN regexp_matches(lower(naam), 'jachthaven|marina|camping|vakantiepark') OR place_id % 3 = 0 THEN 'Ja' ELSE sanitair END AS sanitair"
    )
)
def deduction_texts(spark: SparkSession, d: str) -> DataFrame:
    told = places(spark, d).withColumns(
        {
            "beschrijving": F.expr(_TOLD), "samenvatting_reviews": F.expr(_REVIEWS),
            "check_in_out": F.when(col("place_id") % 5 == 0, "14:00").otherwise("Onbekend")
        }
    )
    return enrich.deduced(told).select("place_id", "check_in_out", "honden_toegestaan", "sanitair")


_POWER = "CASE place_id % 6 WHEN 0 THEN 'Er zijn 12 stroompunten' WHEN 1 THEN '10 ampère' WHEN 2 THEN 'Stroomaansluiting per plek' ELSE 'geen bijzonderheden' END"


@register(
    "deduction_power",
    O.places(
        "place_id, CASE WHEN lower(trim(stroom)) <> 'onbekend' THEN stroom WHEN place_id % 6 < 3 THEN 'Ja' WHEN regexp_matches(lower(naam), 'parking|parkeer') THEN 'Nee' ELSE stroom END AS stroom"
    )
)
def deduction_power(spark: SparkSession, d: str) -> DataFrame:
    """Connections that a description tells of, even at a car park."""
    told = places(spark, d).withColumn("beschrijving", F.expr(_POWER))
    return enrich.deduced(told).select("place_id", "stroom")


@register(
    "no_results",
    O.places(
        f"place_id, 'Geen resultaten voor “' || {O.escape('naam')} || '”' AS said"
    )
)
def no_results(spark: SparkSession, d: str) -> DataFrame:
    """What a search without results says, its query escaped."""
    return places(spark, d).select("place_id", D.no_results(col("naam")).alias("said"))


projected(
    "crowding_by_capacity",
    {
        "drukte": lambda: enrich.crowding_by_capacity(
            F.when(col("place_id") % 9 == 0, "veel").otherwise((col("place_id") % 80).cast("string"))
        )
    },
    {
        "drukte": "CASE WHEN place_id % 9 = 0 THEN 'Onbekend' WHEN place_id % 80 < 20 THEN 'Snel vol in het seizoen' WHEN place_id % 80 > 50 THEN 'Vaak plek beschikbaar' ELSE 'Onbekend' END"
    }
)


#: Of each field of the contract: values it allows, and values it doesn't.
_VALUES = {
    "naam": (["De Hoeve"], ["", "  "]), "provincie": (["Drenthe", "Zuid-Holland"], ["drenthe", "Onbekend"]),
    "prijs": (["€12", "€ 7,50", "Gratis", "Onbekend"], ["12 euro", "gratis"]), "honden_toegestaan": (["Ja", "Nee", "Onbekend"], ["ja", "misschien"]),
    "stroom": (["Ja"], ["Ja "]), "stroom_prijs": (["€2/nacht", "Inbegrepen", "Nee (geen stroom)", "Onbekend"], ["€2", "Nee"]),
    "afvalwater": (["Nee"], ["?"]), "chemisch_toilet": (["Onbekend"], ["nee"]), "water_tanken": (["Ja"], ["JA"]),
    "aantal_plekken": (["12", "Onbekend"], ["twaalf", "12+"]), "check_in_out": (["Vrij", "14:00 - 12:00"], [""]), "beschrijving": (["Mooi. Stil."], [" "]),
    "ondergrond": (["Gras", "Gemengd", "Onbekend"], ["Zand"]), "toegankelijkheid": (["Ja", "Onbekend"], ["Rolstoel"]), "rust": (["Rustig", "Druk"], ["Stil"]),
    "sanitair": (["Nee"], ["douche"]), "wifi": (["Ja"], ["gratis"]), "waterfront": (["Nee"], ["zee"]), "beoordeling": (["4.3", "9", "10", "Onbekend"], ["4.3/5", "11", "goed"]),
    "samenvatting_reviews": (["Onbekend", " ".join(["gasten"] * 20), " ".join(["stil"] * 40)], ["kort", " ".join(["stil"] * 41)]),
    "telefoonnummer": (["+31 6 1234 5678", "+31 20 123 4567", "+31 151 234 567", "Onbekend"], ["0612345678", "+31 6 12345678"]),
    "roken": (["Ja"], ["buiten"]), "feesten": (["Nee"], [""]), "faciliteiten_extra": (["wasserette, winkel"], [""]), "huisregels": (["stil na 22 uur"], [""]),
    "loc_type": (["Camping", "Boerderij"], ["Hotel", "Onbekend"]), "drukte_indicator": (["Vaak plek beschikbaar"], ["  "]), "max_lengte": (["8m", "7,5 m", "Geen beperking"], ["8 meter", "lang"]),
    "max_gewicht": (["3.5t", "Geen beperking", "Onbekend"], ["3.5 ton", "zwaar"]), "remote_work_score": (["Goed"], [""]), "voertuig_types": (["Campervan, Caravan", "Onbekend"], ["campers", "Campervan,Caravan"]),
    "tarieftype": (["Per nacht", "Gratis"], ["Per uur"]), "ai_gecheckt": (["Ja"], ["Nee", "Onbekend"])
}


def _chosen(i: int, good: list[str], bad: list[str]) -> str:
    """SQL: one of a field's values, or null, by place."""
    whens = " ".join(f"WHEN {n} THEN {O.q(v)}" for n, v in enumerate([*good, *bad]))
    return f"CASE (place_id + {7 * i}) % {len(good) + len(bad) + 1} {whens} END"


@register(
    "domain_check",
    O.places(
        "place_id, concat_ws(',', "
        + ", ".join(f"CASE WHEN (place_id + {7 * i}) % {len(g) + len(b) + 1} >= {len(g)} THEN '{c}' END" for i, (c, (g, b)) in enumerate(_VALUES.items()))
        + ") AS errors"
    )
)
def domain_check(spark: SparkSession, d: str) -> DataFrame:
    """Every field of the contract, with values it allows, values it doesn't, and null."""
    said = places(spark, d).selectExpr("place_id", *[f"{_chosen(i, g, b)} AS {c}" for i, (c, (g, b)) in enumerate(_VALUES.items())])
    return said.select("place_id", enrich.domain_errors(said).alias("errors"))


@register(
    "favourites_toggle",
    "SELECT user_id, event_type AS naam FROM events GROUP BY user_id, event_type HAVING count(*) % 2 = 1"
)
def favourites_toggle(spark: SparkSession, d: str) -> DataFrame:
    return curation.toggled(
        spark.read.parquet(f"{d}/events.parquet").select("user_id", col("event_type").alias("naam"))
    )


@register(
    "sidebar_filters",
    O.places(
        "place_id",
        f"WHERE NOT {O.says('prijs', 'gratis')} AND ({O.clean('prijs', '')}) <> '' AND coalesce(({O.score('beoordeling')}) >= 8.0, false) AND {O.says('naam', 'a')}"
    )
)
def sidebar_filters(spark: SparkSession, d: str) -> DataFrame:
    return search.shortlist(places(spark, d), price="paid", least_score=8.0, text=" a ").select("place_id")


@register(
    "shortlist_vehicles",
    O.places(
        "place_id", f"WHERE {O.says('prijs', 'gratis')} AND ({O.metres('max_lengte')}) >= 8.0 AND {O.yes('stroom')}"
    )
)
def shortlist_vehicles(spark: SparkSession, d: str) -> DataFrame:
    return search.shortlist(places(spark, d), price="free", vehicles=["long"], facilities=["stroom"]).select("place_id")


@register(
    "shortlist_favourites",
    O.places(
        "place_id",
        f"WHERE ({O.tons('max_gewicht')}) >= 3.5 AND provincie IN ('Drenthe', 'Zeeland', 'noord-holland') AND naam IN (SELECT naam FROM places WHERE place_id % 10 = 3)"
    )
)
def shortlist_favourites(spark: SparkSession, d: str) -> DataFrame:
    return search.shortlist(
        places(spark, d), provinces=["Drenthe", "Zeeland", "noord-holland"], vehicles=["heavy"],
        favourites=_favourites(spark, d)
    ).select("place_id")


@register(
    "preset_membership",
    O.places(
        "DISTINCT provincie, provincie = 'Zeeland' AS chosen", "WHERE lower(provincie) NOT IN ('onbekend', '', 'nan')"
    )
)
def preset_membership(spark: SparkSession, d: str) -> DataFrame:
    return quality.preset(quality.province_options(places(spark, d)), "Zeeland")


@register(
    "sort_choices",
    O.places(
        f"place_id, {O.score('beoordeling')} AS score, row_number() OVER (ORDER BY {O.score('beoordeling')} DESC NULLS LAST, place_id) AS rank"
    )
)
def sort_choices(spark: SparkSession, d: str) -> DataFrame:
    """All places in the order of their ratings."""
    return search.ordered(places(spark, d), "rating").select(
        "place_id", C.parse_score(col("beoordeling")).alias("score"), "rank"
    )


def ranked(name: str, choice: str, sql: str) -> None:
    """All places with their rank by one of the sort choices."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        return search.ordered(geo.add_distances(places(spark, d), *HOME), choice).select("place_id", "rank")

    register(name, O.places(f"place_id, row_number() OVER (ORDER BY {sql}place_id) AS rank"))(query)


ranked("ranked_by_default", "key", "")
ranked("ranked_by_name", "name", "lower(naam) NULLS FIRST, ")
ranked("ranked_free_first", "free", f"{O.says('prijs', 'gratis')} DESC, lower(naam) NULLS FIRST, ")
ranked("ranked_by_rating", "rating", f"{O.score('beoordeling')} DESC NULLS LAST, ")
ranked("ranked_by_distance", "distance", f"{_KM}, ")


@register("landing_tiles", O.places("format('{:,}', count(*)) AS total, format('{:,}', count(DISTINCT naam)) AS names"))
def landing_tiles(spark: SparkSession, d: str) -> DataFrame:
    counted = places(spark, d).agg(F.count("*").alias("n"), F.count_distinct("naam").alias("m"))
    return counted.select(D.thousands(col("n")).alias("total"), D.thousands(col("m")).alias("names"))


projected(
    "review_block",
    {
        "review": lambda: D.review_block(
            F.when(col("place_id") % 3 == 0, "rustig"), F.when(col("place_id") % 2 == 0, "uitzicht").otherwise("-"),
            F.lit("ver"), col("drukte_indicator")
        )
    },
    {
        "review": f"CASE WHEN place_id % 6 = 0 THEN 'rustig | + uitzicht | - ver' WHEN place_id % 3 = 0 THEN 'rustig | - ver' WHEN place_id % 2 = 0 THEN '+ uitzicht | - ver' ELSE {O.clean('drukte_indicator', '')} END"
    }
)


@register(
    "geocode_lookup",
    f"WITH gazetteer AS ({O.GAZETTEER_SQL}) SELECT city_id, CASE WHEN city_id % 2 = 0 THEN lat END AS lat, CASE WHEN city_id % 2 = 0 THEN lon END AS lon FROM gazetteer"
)
def geocode_lookup(spark: SparkSession, d: str) -> DataFrame:
    cities = gazetteer(spark, d)
    queries = cities.select(
        "city_id", F.when(col("city_id") % 2 == 0, F.lower("admin1")).otherwise(F.lit("nergens")).alias("query")
    )
    return clients.geocode(queries, cities.withColumnRenamed("admin1", "name")).select("city_id", "lat", "lon")


@register(
    "health_status",
    "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'ok' WHEN 1 THEN 'invalid key' WHEN 2 THEN 'forbidden' WHEN 3 THEN 'rate limited' WHEN 4 THEN 'HTTP 500' ELSE 'unreachable' END AS health FROM part"
)
def health_status(spark: SparkSession, d: str) -> DataFrame:
    status = F.expr(
        "CASE p_partkey % 6 WHEN 0 THEN 200 WHEN 1 THEN 400 WHEN 2 THEN 403 WHEN 3 THEN 429 WHEN 4 THEN 500 END"
    )
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", clients.health(status).alias("health"))
