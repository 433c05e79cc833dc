"""Commerce and listing inputs derived from the tables of a test directory.

Each statement runs unchanged on Spark and on the checking engine; ``{name}`` stands
for a table. Every row of a table is read; rows without a partner, an order or a street of their
own are made by changing a key, not by leaving rows out. A voucher goes with every fourth payment.
"""

from __future__ import annotations

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

COMMERCE_SQL = {
    "raw_customers": """
        select c_custkey as customer_id, concat('u', cast(floor(c_custkey / 2) as bigint)) as customer_unique_id,
               lpad(cast(c_custkey % 100000 as varchar(9)), 5, '0') as customer_zip_code_prefix,
               concat('city', c_custkey % 50) as customer_city, n_name as customer_state
        from {customer} join {nation} on c_nationkey = n_nationkey""",
    "raw_orders": """
        select o_orderkey as order_id, o_custkey as customer_id,
               case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'canceled' end as order_status,
               case when o_orderkey % 97 = 0 then null
                    else o_orderdate + (o_orderkey % 24) * interval '1' hour end as order_purchase_timestamp,
               o_orderdate + interval '1' hour as order_approved_at,
               o_orderdate + interval '2' day as order_delivered_carrier_date,
               case when o_orderstatus = 'F' and o_orderkey % 11 <> 0
                    then o_orderdate + (1 + o_orderkey % 37) * interval '1' day end as order_delivered_customer_date,
               case when o_orderkey % 53 = 0 then null
                    else o_orderdate + interval '20' day end as order_estimated_delivery_date
        from {orders}""",
    "raw_order_items": """
        select l_orderkey as order_id, l_linenumber as order_item_id, l_partkey as product_id, l_suppkey as seller_id,
               l_shipdate as shipping_limit_date,
               case when l_quantity = 50 then null else cast(l_extendedprice as decimal(12,2)) end as price,
               cast(l_quantity as decimal(12,2)) as freight_value
        from {lineitem}""",
    "raw_order_payments": """
        select case when o_orderkey % 13 = 0 then -o_orderkey else o_orderkey end as order_id, 1 as payment_sequential, 'credit_card' as payment_type,
               1 as payment_installments, cast(o_totalprice as decimal(12,2)) as payment_value
        from {orders}
        union all
        select case when o_orderkey % 13 = 0 then -o_orderkey else o_orderkey end, 2, 'voucher', 1, cast(10 as decimal(12,2))
        from {orders} where o_orderkey % 4 = 0""",
    "raw_order_reviews": """
        select concat('r', l_orderkey, '-', l_partkey, '-', l_suppkey, '-', l_linenumber, '-',
                      cast(l_quantity as int)) as review_id,
               case when l_returnflag = 'N' then -l_orderkey else l_orderkey end as order_id,
               cast(1 + l_partkey % 5 as int) as review_score,
               case when l_quantity < 10 then '  ' when l_quantity < 20 then null else 'ok' end as review_comment_title,
               cast(null as varchar(10)) as review_comment_message, l_shipdate as review_creation_date,
               case when l_linestatus = 'F' then null else l_shipdate end as review_answer_timestamp
        from {lineitem}""",
    "raw_products": """
        select p_partkey as product_id,
               case when p_size % 10 = 0 then null else lower(p_type) end as product_category_name,
               length(p_name) as product_name_lenght, length(p_name) * 10 as product_description_lenght,
               p_size % 5 as product_photos_qty, p_size * 100 as product_weight_g, p_size as product_length_cm,
               p_size + 1 as product_height_cm, p_size + 2 as product_width_cm
        from {part}""",
    "raw_sellers": """
        select s_suppkey as seller_id, lpad(cast(s_suppkey % 100000 as varchar(9)), 5, '0') as seller_zip_code_prefix,
               concat('city', s_suppkey % 50) as seller_city, n_name as seller_state
        from {supplier} join {nation} on s_nationkey = n_nationkey""",
    "raw_product_category_name_translation": """
        select distinct lower(p_type) as product_category_name,
               case lower(p_type) when 'medium' then 'm_en' when 'standard' then 's_en' when 'large' then 'l_en'
                                  when 'promo' then 'p_en' else 'sm_en' end as product_category_name_english
        from {part} where lower(p_type) <> 'economy'""",
}

# Four listings in a row share ZIP, street, unit and place, so most have several partners in the other feed.
_GROUP = "cast(floor(o_orderkey / 4) as bigint)"
_CELL = "cast(floor(o_orderkey / 8) as bigint) % 25"
_LATITUDE = f"40.5 + ({_CELL} % 5) * 0.05 + ({_GROUP} % 100) * 0.0005"
_LONGITUDE = f"-74.0 + cast(floor(({_CELL}) / 5) as int) * 0.05 + ({_GROUP} % 90) * 0.0005"


def _street(street: str, other: str, units: tuple[str, ...], strays: str) -> str:
    """An address; listings that meet ``strays`` stand in a street that the other feed has not."""
    cases = " ".join(f"when {i} then '{u}'" for i, u in enumerate(units))
    return f"concat({_GROUP} * 4, case when {strays} then ' {other}' else ' {street}' end, case {_GROUP} % 6 {cases} end)"


def _repeated(prefix: str, every: int, rest: int) -> str:
    """Ids, of which some occur twice."""
    return f"concat('{prefix}', case when o_orderkey % {every} = {rest} then o_orderkey - 1 else o_orderkey end)"


def _feed_a(first_zip: int, street: str) -> str:
    units = (" Unit 4B", " Apt 5", " Fl 3", " # 7", "", " Ste 100")
    return f"""
        select {_repeated('a', 12, 5)} as listing_id, cast(1000 + (o_orderkey * 37) % 4000 as int) as list_price,
               case when o_orderkey % 43 = 0 then null else cast(o_orderkey % 5 as float) end as beds,
               cast(1 + (o_orderkey % 3) * 0.5 as float) as baths,
               case when o_orderkey % 4 = 0 then null else cast(400 + (o_orderkey * 13) % 1500 as int) end as sqft,
               case when o_orderkey % 31 = 0 then null else cast(o_orderdate as date) end as list_date,
               lpad(cast({first_zip} + {_CELL} as varchar(5)), 5, '0') as zip_code,
               cast({_LATITUDE} as float) as latitude, cast({_LONGITUDE} as float) as longitude,
               {_street(street, 'Elm St', units, 'o_orderkey % 5 = 4')} as address_line,
               concat('https://a/', o_orderkey) as url,
               case when o_orderkey % 9 = 0 then null else o_orderkey % 2 = 0 end as pet_cats,
               o_orderkey % 3 = 0 as pet_dogs
        from {{orders}}"""


def _feed_b(first_zip: int) -> str:
    """Places and prices lie off those of feed A, some within its tolerances and some beyond."""
    units = (" #4B", " Unit 5", " Fl 3", " Apt 7", "", " Ste 100")
    price = "case when o_orderkey % 7 = 0 then 1000 else (o_orderkey % 9) * 40 end"
    north = "case o_orderkey % 10 when 1 then 0.00015 when 2 then 0.0003 else 0 end"
    east = "case o_orderkey % 11 when 3 then -0.00015 when 4 then -0.0003 else 0 end"
    return f"""
        select {_repeated('b', 12, 7)} as listing_id,
               cast(900 + (o_orderkey * 37) % 4000 + {price} as int) as price_min,
               cast(1101 + (o_orderkey * 37) % 4000 + {price} as int) as price_max,
               case when o_orderkey % 3 = 1 then null else cast(o_orderkey % 5 as float) end as beds_min,
               cast(o_orderkey % 5 + o_orderkey % 2 as float) as beds_max,
               cast(1 as float) as baths_min, cast(1 + o_orderkey % 3 as float) as baths_max,
               case when o_orderkey % 8 = 1 then null else cast(300 + (o_orderkey * 13) % 1500 as int) end as sqft_min,
               cast(501 + (o_orderkey * 13) % 1500 as int) as sqft_max,
               lpad(cast({first_zip} + {_CELL} as varchar(5)), 5, '0') as zip_code,
               cast({_LATITUDE} + {north} as float) as latitude, cast({_LONGITUDE} + {east} as float) as longitude,
               {_street('Main St', 'Oak St', units, 'o_orderkey % 3 = 0')} as address_line,
               concat('https://b/', o_orderkey) as url
        from {{orders}}"""


# Page numbers skip one page of every fifth ZIP.
_PAGE = ("cast(floor(o_orderkey / 500) + case when o_custkey % 5 = 0 and o_orderkey >= 1000 then 1 else 0 end as bigint)")
_NEAR_ZIP = "cast(10001 + o_custkey % 25 as varchar(5))"
# Queens is fetched before Brooklyn, whose ZIP codes are smaller; some queried ZIP codes are in no plan.
_NEW_YORK_QUERY = ("cast(case o_custkey % 3 when 0 then 11354 when 1 then 11201 else 10001 end + o_custkey % 25 as varchar(5))")
_NEW_YORK_OWN = ("cast(case o_custkey % 3 when 0 then 11354 when 1 then 11201 else 10001 end + o_orderkey % 25 as varchar(5))")
_BOSTON_QUERY = "lpad(cast(2108 + o_custkey % 28 as varchar(5)), 5, '0')"
_BOSTON_OWN = "lpad(cast(2108 + o_orderkey % 28 as varchar(5)), 5, '0')"


def _landed_a(query_zip: str, own_zip: str) -> str:
    return f"""
        select o_orderkey as ordinal, {query_zip} as query_zip,
               {_PAGE} as page,
               concat('a', cast(floor(o_orderkey / 2) as bigint)) as listing_id,
               cast(1000 + (o_orderkey * 37) % 4000 as varchar(9)) as list_price,
               case when o_orderkey % 17 = 0 then 'soon' when o_orderkey % 19 = 0 then null
                    else concat(substring(cast(o_orderdate as varchar(30)), 1, 10), 'T08:30:00') end as list_date,
               case when o_orderkey % 23 = 0 then null else concat('p-', o_orderkey) end as permalink,
               case when o_orderkey % 11 = 0 then null
                    else case o_orderkey % 7 when 0 then '2+' when 1 then 'Studio' when 2 then '1.5 bd'
                         else cast(o_orderkey % 5 as varchar(3)) end end as beds,
               case when o_orderkey % 11 = 0 then null
                    else case o_orderkey % 6 when 0 then '1+' when 1 then ' 2.5+ ' when 2 then '' else '3' end end as baths,
               case when o_orderkey % 11 = 0 then null
                    when o_orderkey % 29 = 0 then 'large' else cast(400 + (o_orderkey * 13) % 1500 as varchar(9)) end as sqft,
               case when o_orderkey % 13 = 0 then null
                    when o_orderkey % 3 = 0 then concat({own_zip}, '-0042')
                    else {own_zip} end as zip_code,
               case when o_orderkey % 13 = 0 then null else concat(o_orderkey, ' Main St Apt 5') end as address_line,
               case when o_orderkey % 13 = 0 or o_orderkey % 37 = 0 then null
                    else cast(40.5 + (o_orderkey % 100) * 0.0005 as double) end as latitude,
               case when o_orderkey % 13 = 0 or o_orderkey % 37 = 0 then null
                    else cast(-74.0 + (o_orderkey % 90) * 0.0005 as double) end as longitude,
               case when o_orderkey % 9 = 0 then null else o_orderkey % 2 = 0 end as pet_cats,
               case when o_orderkey % 9 = 0 then null else o_orderkey % 3 = 0 end as pet_dogs
        from {{orders}}"""


def _landed_b(query_zip: str, own_zip: str) -> str:
    return f"""
        select o_orderkey as ordinal, {query_zip} as query_zip,
               {_PAGE} as page,
               case when o_orderkey % 41 = 0 then null else concat('b', cast(floor(o_orderkey / 2) as bigint)) end
                 as listing_id,
               cast(900 + (o_orderkey * 37) % 4000 as varchar(9)) as price_min,
               case when o_orderkey % 7 = 0 then null else cast(1101 + (o_orderkey * 37) % 4000 as varchar(9)) end
                 as price_max,
               cast(o_orderkey % 5 as varchar(3)) as beds_min, cast(o_orderkey % 5 + 1 as varchar(3)) as beds_max,
               '1' as baths_min, case when o_orderkey % 2 = 0 then '2.5' else 'n/a' end as baths_max,
               case when o_orderkey % 8 = 1 then null else cast(300 + (o_orderkey * 13) % 1500 as varchar(9)) end as sqft_min,
               case when o_orderkey % 8 = 1 then null else cast(501 + (o_orderkey * 13) % 1500 as varchar(9)) end as sqft_max,
               case when o_orderkey % 13 = 0 then null
                    when o_orderkey % 3 = 0 then concat({own_zip}, '-0042')
                    else {own_zip} end as zip_code,
               case when o_orderkey % 13 = 0 then null else cast(40.5 + (o_orderkey % 100) * 0.0005 as double) end
                 as latitude,
               case when o_orderkey % 13 = 0 then null else cast(-74.0 + (o_orderkey % 90) * 0.0005 as double) end
                 as longitude,
               case when o_orderkey % 13 = 0 then null else concat(o_orderkey, ' Main St #5') end as address_line,
               case when o_orderkey % 23 = 0 then null else concat('/home/', o_orderkey) end as path
        from {{orders}}"""


# Rings relative to the origin of an area, in degrees: (part, ring, which areas have it, corners). The outer one is
# concave; some areas have a hole, some a second part above the dent.
RINGS = (
    (1, 1, "true", ((0.0, 0.0), (0.05, 0.0), (0.05, 0.05), (0.02, 0.03), (0.0, 0.05))),
    (1, 2, "n_nationkey % 3 = 0", ((0.02, 0.005), (0.03, 0.005), (0.03, 0.02), (0.02, 0.02))),
    (2, 1, "n_nationkey % 4 = 1", ((0.022, 0.043), (0.035, 0.043), (0.035, 0.048), (0.022, 0.048))),
)


def _corner(part: int, ring: int, has: str, i: int, dx: float, dy: float) -> str:
    """A projected vertex, in feet; a degree is about 277,400 feet to the east and 364,500 to the north."""
    return f"""
        select {_AREA} as nta2020, {part} as part, {ring} as ring, {i} as corner,
               cast(984250 + floor(n_nationkey / 5) * 13870 + {round(dx * 277400, 1)} as double) as x,
               cast(121500 + (n_nationkey % 5) * 18225 + {round(dy * 364500, 1)} as double) as y
        from {{nation}} where {has}"""


_AREA = "concat('NT', lpad(cast(n_nationkey as varchar(4)), 4, '0'))"


def _corners():
    for part, ring, has, corners in RINGS:
        for i, (dx, dy) in enumerate(corners, 1):
            yield _corner(part, ring, has, i, dx, dy)
        # Every other area repeats the first vertex of a ring at its end.
        yield _corner(part, ring, f"{has} and n_nationkey % 2 = 0", len(corners) + 1, *corners[0])


# A street with a dot tells the loose split from the strict one.
LISTING_SQL = {
    "ny_feed_a": _feed_a(10000, "Main St."),
    "ny_feed_b": _feed_b(10000),
    "bos_feed_a": _feed_a(2108, "Main St"),
    "bos_feed_b": _feed_b(2108),
    "area_vertices": " union all ".join(_corners()),
    # Attributes of the same areas, padded as in the boundary file.
    "area_text": f"""
        select concat('  ', n_regionkey + 1) as borocode, concat(r_name, '   ') as boroname,
               lpad(cast(n_nationkey as varchar(3)), 3, '0') as countyfips, concat({_AREA}, '  ') as nta2020,
               concat('nta ', n_name, '    ') as ntaname, concat(substring(n_name, 1, 4), ' ') as ntaabbrev, '0' as ntatype,
               'CD' as cdta2020, 'CD' as cdtaname, ' 1.5' as shape_leng, ' 2.5' as shape_area
        from {{nation}} join {{region}} on n_regionkey = r_regionkey""",
    # Boundary attributes as padded text, one row per supplier.
    "boundary_text": """
        select concat('  ', s_nationkey % 5 + 1) as borocode, concat(r_name, '   ') as boroname,
               lpad(cast(s_nationkey as varchar(3)), 3, '0') as countyfips,
               concat('NT', lpad(cast(s_suppkey % 10000 as varchar(4)), 4, '0')) as nta2020,
               concat(s_name, ' ', n_name, '     ') as ntaname, concat(substring(n_name, 1, 4), '  ') as ntaabbrev,
               cast(s_suppkey % 10 as varchar(1)) as ntatype,
               concat('CD', lpad(cast(s_suppkey % 71 as varchar(2)), 2, '0')) as cdta2020,
               concat('CD ', n_name, '  ') as cdtaname, concat(' ', s_suppkey * 10, '.25') as shape_leng,
               concat(' ', s_suppkey * 1000, '.5') as shape_area
        from {supplier} join {nation} on s_nationkey = n_nationkey join {region} on n_regionkey = r_regionkey""",
    # Projected vertices in feet, five per supplier and order-independent.
    "projected_vertices": " union all ".join(f"""
        select s_suppkey as area_id, {i} as corner,
               cast(920000 + (s_suppkey * 977) % 140000 + {i * 300} as double) as x,
               cast(125000 + (s_suppkey * 1409) % 140000 + {i * i * 200} as double) as y
        from {{supplier}}""" for i in range(1, 6)),
    # Landed records before nesting: mixed types, bad dates, absent objects, repeated ids.
    "landed_a": _landed_a(_NEAR_ZIP, _NEAR_ZIP),
    "landed_b": _landed_b(_NEAR_ZIP, _NEAR_ZIP),
    # The same for the ingest of each city: the queried ZIP is spread over boroughs and not always the own one.
    "fetched_new_york_a": _landed_a(_NEW_YORK_QUERY, _NEW_YORK_OWN),
    "fetched_new_york_b": _landed_b(_NEW_YORK_QUERY, _NEW_YORK_OWN),
    "fetched_boston_a": _landed_a(_BOSTON_QUERY, _BOSTON_OWN),
    "fetched_boston_b": _landed_b(_BOSTON_QUERY, _BOSTON_OWN),
    # Pages without a listing: feed A ends some ZIPs with one, feed B announces listings it never sends.
    "empty_a": """
        select query_zip, max(page) + 1 as page
        from (select cast(10001 + o_custkey % 25 as varchar(5)) as query_zip, """ + _PAGE + """ as page from {orders}) as q
        where cast(query_zip as int) % 3 = 0 group by query_zip""",
    # Bodies that are no page: cut off, of another shape, or missing.
    "broken_pages": """
        select cast(10001 + o_custkey % 25 as varchar(5)) as query_zip, o_orderkey as page,
               case o_orderkey % 4 when 0 then '{{"properties": [' when 1 then '[1, 2]' when 2 then 'timeout' end as body
        from {orders} where o_orderkey % 64 < 4""",
    "empty_b": """
        select distinct concat('9', cast(10001 + o_custkey % 25 as varchar(5))) as query_zip, cast(0 as bigint) as page,
               cast(50 as bigint) as total
        from {orders}""",
    # What feed B announced per ZIP: every fourth ZIP promises one listing more.
    "announced_b": """
        select query_zip, count(*) + case when cast(query_zip as int) % 4 = 0 then 1 else 0 end as total
        from (select cast(10001 + o_custkey % 25 as varchar(5)) as query_zip from {orders}) as q
        group by query_zip""",
}

STATEMENTS = {**COMMERCE_SQL, **LISTING_SQL}
