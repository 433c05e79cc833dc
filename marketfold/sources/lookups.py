"""ZIP lookups of the two cities, as data. Callers may pass tables of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Boston ZIP codes, in the order in which they are queried, and their neighborhood.
BOSTON_NEIGHBORHOODS = {
    "02108": "Beacon Hill",
    "02109": "Financial District",
    "02110": "Financial District",
    "02111": "Chinatown",
    "02113": "North End",
    "02114": "West End",
    "02115": "Longwood",
    "02116": "Back Bay",
    "02118": "South End",
    "02119": "Roxbury",
    "02120": "Mission Hill",
    "02121": "Dorchester",
    "02122": "Dorchester",
    "02124": "Dorchester",
    "02125": "Dorchester",
    "02126": "Mattapan",
    "02127": "South Boston",
    "02128": "East Boston",
    "02129": "Charlestown",
    "02130": "Jamaica Plain",
    "02131": "Roslindale",
    "02132": "West Roxbury",
    "02134": "Allston",
    "02135": "Brighton",
    "02136": "Hyde Park",
    "02199": "Back Bay",
    "02210": "Seaport",
    "02215": "Fenway",
}

# New York ZIP codes queried on feed A, per borough, in the order in which they are queried.
NEW_YORK_ZIPS_FEED_A = {
    "Manhattan": [
        "10001", "10002", "10003", "10004", "10006", "10007", "10009", "10010", "10011", "10012", "10013", "10014",
        "10016", "10017", "10018", "10019", "10021", "10022", "10023", "10024", "10025", "10026", "10027", "10028",
        "10029", "10030", "10031", "10032", "10033", "10034", "10035", "10036", "10037", "10038", "10039", "10040",
        "10044", "10065", "10069", "10075", "10128", "10280"
    ],
    "Staten Island": [
        "10301", "10302", "10303", "10304", "10305", "10306", "10307", "10308", "10309", "10310", "10312", "10314"
    ],
    "Bronx": [
        "10451", "10453", "10454", "10455", "10456", "10457", "10458", "10459", "10460", "10461", "10462", "10463",
        "10464", "10465", "10466", "10467", "10468", "10469", "10470", "10471", "10472", "10473", "10475"
    ],
    "Queens": [
        "11004", "11101", "11102", "11103", "11104", "11105", "11106", "11354", "11355", "11356", "11357", "11358",
        "11360", "11361", "11362", "11363", "11364", "11365", "11366", "11367", "11368", "11369", "11370", "11372",
        "11373", "11374", "11375", "11377", "11378", "11379", "11385", "11411", "11412", "11413", "11414", "11415",
        "11416", "11417", "11418", "11419", "11420", "11421", "11422", "11423", "11426", "11427", "11428", "11429",
        "11432", "11433", "11434", "11435", "11436", "11691", "11692", "11693", "11694"
    ],
    "Brooklyn": [
        "11201", "11203", "11204", "11205", "11206", "11207", "11208", "11209", "11210", "11211", "11212", "11213",
        "11214", "11215", "11216", "11217", "11218", "11219", "11220", "11221", "11222", "11223", "11224", "11225",
        "11226", "11228", "11229", "11230", "11231", "11232", "11233", "11234", "11235", "11236", "11237", "11238",
        "11249"
    ],
}

# New York ZIP codes queried on feed B, likewise.
NEW_YORK_ZIPS_FEED_B = {
    "Manhattan": [
        "10001", "10002", "10003", "10004", "10006", "10007", "10009", "10010", "10011", "10012", "10013", "10014",
        "10016", "10017", "10018", "10019", "10021", "10022", "10023", "10024", "10025", "10026", "10027", "10028",
        "10029", "10030", "10031", "10032", "10033", "10034", "10035", "10036", "10037", "10038", "10039", "10040",
        "10044", "10065", "10069", "10075", "10128", "10280"
    ],
    "Staten Island": [
        "10301", "10304", "10305", "10306", "10308"
    ],
    "Bronx": [
        "10451", "10454", "10455", "10456", "10457", "10458", "10461", "10462", "10463", "10466", "10467", "10468",
        "10471", "10473"
    ],
    "Queens": [
        "11004", "11101", "11102", "11103", "11104", "11105", "11106", "11354", "11355", "11356", "11357", "11358",
        "11360", "11361", "11362", "11363", "11364", "11365", "11366", "11367", "11368", "11369", "11370", "11372",
        "11373", "11374", "11375", "11377", "11378", "11379", "11385", "11411", "11412", "11413", "11414", "11415",
        "11416", "11417", "11418", "11419", "11420", "11421", "11422", "11423", "11426", "11427", "11428", "11429",
        "11432", "11433", "11434", "11435", "11436", "11691", "11692", "11693", "11694"
    ],
    "Brooklyn": [
        "11201", "11203", "11205", "11206", "11207", "11208", "11209", "11211", "11212", "11214", "11215", "11216",
        "11217", "11218", "11220", "11221", "11222", "11224", "11225", "11226", "11228", "11229", "11230", "11231",
        "11233", "11234", "11235", "11237", "11238", "11249"
    ],
}


def neighborhood_rows() -> list[tuple[str, str]]:
    return list(BOSTON_NEIGHBORHOODS.items())


def borough_rows(feed: str = "a") -> list[tuple[str, str]]:
    per_borough = NEW_YORK_ZIPS_FEED_A if feed == "a" else NEW_YORK_ZIPS_FEED_B
    return [(z, borough) for borough, zips in per_borough.items() for z in zips]


def plan_rows(city: str, feed: str) -> list[tuple[str, str, int]]:
    """(ZIP, area, place in the fetch order) of the ZIP codes that a feed is asked for."""
    rows = neighborhood_rows() if city == "boston" else borough_rows(feed)
    return [(z, area, i) for i, (z, area) in enumerate(rows)]


def _literal_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Rows as literals in the plan, so that Spark knows their size."""
    cells = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {cells} as lookup({names})")


def zip_to_neighborhood(spark: SparkSession) -> DataFrame:
    return _literal_table(spark, neighborhood_rows(), "zip, neighborhood")


def zip_to_borough(spark: SparkSession, feed: str = "a") -> DataFrame:
    return _literal_table(spark, borough_rows(feed), "zip, borough")


def fetch_plan(spark: SparkSession, city: str, feed: str) -> DataFrame:
    """(query_zip, query_area, ordinal): which ZIP codes are fetched, and in which order."""
    return _literal_table(spark, plan_rows(city, feed), "query_zip, query_area, ordinal")
