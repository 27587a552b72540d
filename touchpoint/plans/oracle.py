"""DuckDB SQL oracles, one per registered query (same keys as ``catalog.QUERIES``).

Each oracle states the rule of its query in set form, and takes no rule list from the
code under test: channel, click, page and phone rules are written out here. The driver's
tables are pre-registered as views; the logical tables (web events, leads, phone map,
...) are derived here as ``touchpoint.sources.fixtures`` derives them.
"""

from __future__ import annotations

import datetime as dt

from touchpoint.plans import catalog as C
from touchpoint.sources import fixtures as FX

NONPAID = "!Non-Paid"


def _q(v) -> str:
    if v is None:
        return "NULL"
    return "'" + str(v).replace("'", "''") + "'"


def _pick(idx: str, values) -> str:
    whens = " ".join(f"WHEN {idx} = {i} THEN {_q(v)}" for i, v in enumerate(values))
    return f"(CASE {whens} END)"


def _ts(v: dt.datetime | dt.date) -> str:
    if not isinstance(v, dt.datetime):
        v = dt.datetime(v.year, v.month, v.day)
    return f"TIMESTAMP '{v.isoformat(sep=' ')}'"


def _day(v: dt.date) -> str:
    return v.strftime("%Y%m%d")


# ------------------------------------------------------------------ views
def _url(eid="event_id", uid="user_id", et="event_type") -> str:
    base = f"('https://www.example.com/' || {_pick(f'{uid} % 5', FX.CARS)} || '/' || {et})"
    src = _pick(f"{eid} % 4", FX.UTM_SOURCES)
    med = _pick(f"{uid} % 3", FX.UTM_MEDIUMS)
    full = (
        f"{base} || '?utm_source=' || {src} || '&utm_medium=' || {med} || "
        f"'&utm_campaign=camp_' || CAST({uid} % 6 AS VARCHAR) || "
        f"'&utm_content=ad' || CAST({eid} % 3 AS VARCHAR) || '&gclid=' || CAST({eid} AS VARCHAR)"
    )
    return (
        f"(CASE WHEN {et} = 'error' THEN {base} "
        f"WHEN {eid} % 7 = 0 THEN {base} || '?ref=home' "
        f"WHEN {eid} % 5 = 0 THEN {base} || '?utm_source=' || {src} "
        f"WHEN {eid} % 5 = 1 THEN {base} || '?utm_source=' || {src} || '&utm_medium=' || {med} "
        f"ELSE {full} END)"
    )


def _event_name(et="event_type") -> str:
    whens = " ".join(f"WHEN {et} = {_q(k)} THEN {_q(v)}" for k, v in FX.EVENT_NAMES.items())
    return f"(CASE {whens} ELSE {et} END)"


_MED = _pick("user_id % 3", FX.UTM_MEDIUMS)
_SESSION = (
    "(CASE WHEN event_id % 19 <> 0 THEN CAST((user_id - CASE WHEN user_id % 8 = 1 THEN 1 ELSE 0 END) * 100000"
    " + (CAST(ts AS DATE) - DATE '1970-01-01') AS BIGINT) END)"
)
_VISITOR = "CASE WHEN event_id % 23 = 0 THEN 'anon-' ELSE '' END || CAST(user_id AS VARCHAR)"
_MEDIUM_PARAM = f"(CASE WHEN event_id % 3 = 0 THEN NULL ELSE {_MED} END)"

GA_EVENTS = f"""
ga_events AS (
  SELECT
    strftime(ts, '%Y%m%d') AS event_date,
    epoch_us(ts) AS event_timestamp,
    {_event_name()} AS event_name,
    {_VISITOR} AS user_pseudo_id, user_id,
    [{{'key': 'page_location', 'value': {{'string_value': {_url()}, 'int_value': NULL::BIGINT}}}},
     {{'key': 'ga_session_id', 'value': {{'string_value': NULL::VARCHAR, 'int_value': {_SESSION}}}}},
     {{'key': 'medium', 'value': {{'string_value': {_MEDIUM_PARAM}, 'int_value': NULL::BIGINT}}}}
    ] AS event_params,
    CASE WHEN user_id % 2 = 0 THEN 'www.example.com' ELSE 'm.example.com' END AS hostname,
    {_pick('event_id % 12', FX.TRAFFIC_MEDIUMS)} AS medium,
    CASE WHEN event_id % 4 = 0 THEN {_MED} END AS manual_medium,
    CASE WHEN event_id % 5 >= 2 THEN 'g' || CAST(event_id AS VARCHAR) END AS gclid,
    CASE WHEN event_id % 10 = 3 THEN 'd' || CAST(user_id AS VARCHAR) END AS dclid,
    NULL::VARCHAR AS srsltid
  FROM events
)"""

PHONE_MAP = """
phone_map AS (
  WITH c AS (SELECT c_custkey AS k, lpad(CAST(c_custkey AS VARCHAR), 7, '0') AS d FROM customer)
  SELECT CAST(k AS VARCHAR) AS user_pseudo_id,
         CASE WHEN k % 10 = 7 THEN NULL WHEN k % 31 = 4 THEN '62'
              WHEN k % 9 = 0 THEN '6262812' || d ELSE '62812' || d END AS phone_no
  FROM c
  UNION ALL
  SELECT CAST(k AS VARCHAR), '62813' || d FROM c WHERE k % 7 = 2
)"""


def _lead_phone(k="c_custkey") -> str:
    d = f"lpad(CAST({k} AS VARCHAR), 7, '0')"
    whens = " ".join(
        f"WHEN {k} % 8 = {i} THEN {_q(p)} || {d}" for i, p in enumerate(FX.PHONE_PREFIXES)
    )
    return f"(CASE WHEN {k} % 29 = 28 THEN NULL {whens} END)"


def _lead_cols(k, name, nation, segment, mult) -> str:
    return (
        f"{name} AS fullname, "
        f"CASE WHEN {k} % 13 = 5 THEN NULL ELSE 'City ' || CAST({nation} AS VARCHAR) END AS city, "
        f"{_lead_phone(k)} AS phone, "
        f"lower(replace({name}, '#', '.')) || '@mail.example.com' AS email, "
        f"{segment} AS estimated_buying_time, "
        f"TIMESTAMP '2024-01-01 00:00:00' + to_minutes(CAST(({k} * {mult}) % {FX.LEAD_SPREAD_MIN} AS BIGINT)) AS created_utc, "
        f"{_pick(f'{k} % 4', ['Serena', 'Terra', 'Magnite', 'Kicks'])} AS car_name"
    )


TD_LEADS = f"""
td_leads AS (
  SELECT {_lead_cols('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 7919)},
         'Dealer ' || CAST(c_nationkey % 5 AS VARCHAR) AS dealer_name
  FROM customer
  UNION ALL
  SELECT {_lead_cols('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 7919)},
         CASE WHEN c_custkey % 3 = 0 THEN 'Dealer X'
              ELSE 'Dealer ' || CAST(c_nationkey % 5 AS VARCHAR) END AS dealer_name
  FROM customer
)"""

BR_LEADS = f"""
br_leads AS (
  SELECT {_lead_cols('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 104729)},
         NULL::VARCHAR AS dealer_name
  FROM customer
  UNION ALL
  SELECT {_lead_cols('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 104729)},
         NULL::VARCHAR AS dealer_name
  FROM customer
)"""

_OFFER_NAME = "('Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'))"
OFFER_LEADS = f"""
offer_leads AS (
  SELECT {_OFFER_NAME} AS fullname,
         CASE WHEN o_custkey % 13 = 5 THEN NULL ELSE 'City ' || CAST(o_custkey % 25 AS VARCHAR) END AS city,
         {_lead_phone('o_custkey')} AS phone,
         lower(replace({_OFFER_NAME}, '#', '.')) || '@mail.example.com' AS email,
         o_orderpriority AS estimated_buying_time,
         {_pick('o_orderkey % 3', ['google', 'facebook', None])} AS referer,
         o_orderdate AS created_at,
         {_pick('o_orderkey % 4', ['Serena', 'Terra', 'Magnite', 'Kicks'])} AS car_name,
         o_orderstatus || '-' || o_orderpriority AS description
  FROM orders
)"""


def _norm_phone(x: str) -> str:
    """First the country code: a number with a space, or with the code, stays; a plus goes;
    any other gets the code in place of one leading zero. Then spaces, capital O and
    hyphens go. Then what starts 620 is cut to the code, and what lacks the code gets it."""
    coded = (
        f"CASE WHEN contains({x}, ' ') OR starts_with({x}, '62') THEN {x} "
        f"WHEN starts_with({x}, '+') THEN {x}[2:] ELSE '62' || regexp_replace({x}, '^0', '') END"
    )
    p = f"regexp_replace({coded}, '[ O-]', '', 'g')"
    return f"(CASE WHEN starts_with({p}, '620') THEN '62' WHEN starts_with({p}, '62') THEN {p} ELSE '62' || {p} END)"


def _mapped_phone(x: str) -> str:
    return f"regexp_replace({x}, '^6262', '62')"


def _local(x: str) -> str:
    return f"({x} + INTERVAL 7 HOUR)"  # Asia/Jakarta: UTC+7, no DST


def _sink(name: str, leads: str) -> str:
    return f"""
{name} AS (
  SELECT DISTINCT fullname, city, {_norm_phone('phone')} AS phone, email, estimated_buying_time,
         {_local('created_utc')} AS created_at, car_name, dealer_name,
         'Non-Paid' AS utm_source, NULL::VARCHAR AS utm_medium, NULL::VARCHAR AS utm_campaign,
         NULL::VARCHAR AS utm_content
  FROM {leads}
  WHERE {_local('created_utc')} < {_ts(FX.LOADED_CUTOFF_LOCAL)}
)"""


TD_SINK = _sink("td_sink", "td_leads")
BR_SINK = _sink("br_sink", "br_leads")

_CLICK_URL = "(CASE " + " ".join(
    [f"WHEN user_id % 12 = 5 THEN {_q(FX.CLICK_URLS['view'])}"]
    + [f"WHEN event_type = {_q(k)} THEN {_q(v)}" for k, v in FX.CLICK_URLS.items()]
) + f" ELSE {_q(FX.SOCIAL_URL)} || CAST(event_id AS VARCHAR) END)"

SMALL_VIEWS = f"""
clicks AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(event_id AS VARCHAR) AS event_id,
         CASE WHEN event_id % 10 = 0 THEN {_q(FX.OTHER_STORY)} ELSE {_q(FX.MAIN_STORY)} END AS story_id,
         {_CLICK_URL} AS click_url, ts AS tracked_time
  FROM events
),
link AS (
  SELECT CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS user_id,
         CASE WHEN c_custkey % 12 = 5 THEN NULL ELSE CAST(c_custkey AS VARCHAR) END AS customer_id
  FROM customer
),
sign_in AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id,
         CASE WHEN user_id % 12 <> 5 THEN CAST(user_id AS VARCHAR) END AS customer_id
  FROM events WHERE event_type = 'signup'
),
open_order AS (
  SELECT CAST(o_custkey AS VARCHAR) AS customer_id, o_orderpriority AS story_id
  FROM orders WHERE o_orderstatus = 'O'
),
signed AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, ts AS tracked_time FROM events WHERE event_type = 'signup'
),
viewed AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, ts AS tracked_time FROM events WHERE event_type = 'view'
),
clicked AS (
  SELECT CAST(user_id AS VARCHAR) AS customer_id, ts AS tracked_time FROM events WHERE event_type = 'click'
),
customers AS (
  SELECT CAST(c_custkey AS VARCHAR) AS customer_id,
         CASE WHEN c_custkey % 11 = 3 THEN NULL ELSE 'c' || CAST(c_custkey AS VARCHAR) || '@mail.example.com' END AS email,
         c_name AS name
  FROM customer
),
ad AS (
  SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS campaign_name,
         o_orderkey % 50 AS impressions, o_custkey % 7 AS clicks_all
  FROM orders
),
ad_frequency AS (
  SELECT CAST(l_shipdate AS DATE) AS date, count(*) AS frequency FROM lineitem GROUP BY 1
),
station AS (
  SELECT p_retailprice AS LAT_N, p_retailprice / 7.0 AS LONG_W FROM part
),
campaign AS (
  SELECT o_orderkey AS destination_id, o_orderstatus AS status, o_orderpriority AS label_ids,
         o_custkey AS c_user_id, 'channel_' || CAST(o_orderkey % 3 AS VARCHAR) AS channel_name,
         CAST(o_orderdate AS DATE) AS end_date, o_orderdate AS ctime
  FROM orders
),
shop_customer AS (
  SELECT c_custkey AS customer_id, 'City ' || CAST(c_nationkey AS VARCHAR) AS city FROM customer
),
shop_orders AS (
  SELECT o_custkey AS customer_id, o_orderkey AS order_id, CAST(floor(o_totalprice) AS BIGINT) AS "order"
  FROM orders
),
page_view AS (
  SELECT CAST(user_id AS VARCHAR) AS user_id FROM events WHERE event_type = 'view'
)"""


def _matched_by_type(name: str, event_type: str) -> str:
    return f"""
{name} AS (
  SELECT CAST(user_id AS VARCHAR) AS fullname, 'camp_' || CAST(user_id % 6 AS VARCHAR) AS utm_campaign,
         ts AS created_at
  FROM events WHERE event_type = {_q(event_type)}
)"""


MATCHED_VIEWS = ",".join(
    _matched_by_type(f"matched_{i}", et) for i, (_, et) in enumerate(FX.LEAD_TYPE_EVENTS)
)

ALL_VIEWS = ",".join(
    [GA_EVENTS, PHONE_MAP, TD_LEADS, BR_LEADS, OFFER_LEADS, TD_SINK, BR_SINK, SMALL_VIEWS,
     MATCHED_VIEWS]
)


def _with(*ctes: str, body: str) -> str:
    parts = [ALL_VIEWS] + [c for c in ctes if c]
    return "WITH " + ",".join(parts) + "\n" + body


# --------------------------------------------------------------- expressions
def _param(key: str, kind: str = "string_value", arr: str = "event_params") -> str:
    return f"list_filter({arr}, lambda p: p.key = {_q(key)})[1].value.{kind}"


def _utm(url: str) -> dict[str, str]:
    def cut(start, end):
        return f"string_split(string_split({url}, {_q(start)})[2], {_q(end)})[1]"

    return {
        "utm_source": f"CASE WHEN regexp_matches({url}, 'utm_source') THEN {cut('?utm_source=', '&utm_medium')} ELSE {_q(NONPAID)} END",
        "utm_medium": f"CASE WHEN regexp_matches({url}, 'utm_medium') THEN {cut('&utm_medium=', '&utm_campaign')} END",
        "utm_campaign": f"CASE WHEN regexp_matches({url}, 'utm_campaign') THEN {cut('&utm_campaign=', '&utm_content')} END",
        "utm_content": f"CASE WHEN regexp_matches({url}, 'utm_content') THEN {cut('&utm_content=', '&')} END",
    }


def _utm_select(url: str) -> str:
    return ", ".join(f"{v} AS {k}" for k, v in _utm(url).items())


def _channel(m: str) -> str:
    """Medium -> channel: the first word found in it decides."""
    words = "none organic referral cpc|ppc|cpm email social video".split()
    names = ["Direct", "Organic", "Referral", "Paid Search/Display", "Email", "Organic Social", "Organic Video"]
    cases = " ".join(f"WHEN regexp_matches({m}, '{w}') THEN '{n}'" for w, n in zip(words, names))
    return f"(CASE {cases} WHEN {m} IS NULL THEN 'Null Medium' ELSE 'Unassigned' END)"


def _click_class(u: str) -> str:
    """Click URL -> type of page; a forgotten password wins over the page it comes from."""
    return (
        f"(CASE WHEN contains({u}, 'account/forget-password') THEN 'Forget password' "
        f"WHEN contains({u}, '/sg-en?') OR suffix({u}, '/sg-en') THEN 'Homepage' "
        f"WHEN contains({u}, '/sg-en/contactus/contact-us') THEN 'Download Catalogue' "
        f"WHEN contains({u}, '/sg-en/account/sign-in') THEN 'Log-in page' ELSE 'Social Media' END)"
    )


def _page_class(p: str) -> str:
    return (
        f"(CASE WHEN contains({p}, 'serena') OR contains({p}, 'terra') THEN 'Type 1' "
        f"WHEN contains({p}, 'magnite') OR contains({p}, 'kicks') THEN 'Type 2' ELSE 'Type 3' END)"
    )


# -------------------------------------------------------------- attribution
TEST_DRIVE, BROCHURE = "dax_testdrive_beforedealer_conversion", "dax_downloadbrochure_conversion"
_UTM4 = "utm_source, utm_medium, utm_campaign, utm_content"
_FORM = "fullname, city, phone, email, estimated_buying_time, created_at, car_name"
_WATERMARK = "(SELECT max(created_at) FROM td_sink)"


def _window(days: int | None) -> tuple[str, str, str, str]:
    """(after, before, first day, last day) of a load; None: since the sink's newest lead."""
    upper = dt.datetime.combine(C.AS_OF, dt.time(0))
    last = f"'{_day(C.AS_OF - dt.timedelta(days=1))}'"
    if days is None:
        return _WATERMARK, _ts(upper), f"strftime({_WATERMARK} + INTERVAL 1 MICROSECOND, '%Y%m%d')", last
    lower = dt.datetime.combine(C.AS_OF - dt.timedelta(days=days), dt.time(0))
    return _ts(lower), _ts(upper), f"'{_day(lower.date())}'", last


def _forms(days: int | None, brochure: bool = False) -> str:
    """``form``: one row per submission of the window, cleaned."""
    after, before, _, _ = _window(days)
    view, dealer = ("br_leads", "") if brochure else ("td_leads", ", dealer_name")
    return f"""
form AS (
  SELECT fullname, city, {_norm_phone('phone')} AS phone, email, estimated_buying_time,
         {_local('created_utc')} AS created_at, car_name{dealer}, phone AS phone_raw
  FROM (SELECT DISTINCT fullname, city, phone, email, estimated_buying_time, created_utc, car_name{dealer} FROM {view})
  WHERE {_local('created_utc')} > {after} AND {_local('created_utc')} < {before}
)"""


def _visits(days: int | None, conversion: str, anyone: bool = False, own: bool = False) -> str:
    """``visit``: events of users with a phone-map row. ``touch``: their UTM fields and
    whether their session converts: by an event of such a user (or ``anyone``), in a
    session named by its id (or with the user: ``own``)."""
    _, _, first, last = _window(days)
    by = "(v.user_pseudo_id, v.sid)" if own else "v.sid"
    names = "user_pseudo_id, sid" if own else "sid"
    registered = "" if anyone else "AND user_pseudo_id IN (SELECT user_pseudo_id FROM phone_map)"
    return f"""
web AS (
  SELECT user_pseudo_id, event_name, {_local('make_timestamp(event_timestamp)')} AS log_time,
         {_param('page_location')} AS page_location, {_param('ga_session_id', 'int_value')} AS sid
  FROM ga_events WHERE event_date BETWEEN {first} AND {last}
),
visit AS (
  SELECT w.*, {_mapped_phone('m.phone_no')} AS phone_no FROM web w JOIN phone_map m USING (user_pseudo_id)
),
buyer AS (
  SELECT DISTINCT {names} FROM web WHERE event_name = {_q(conversion)} AND sid IS NOT NULL {registered}
),
touch AS (
  SELECT user_pseudo_id, phone_no, log_time, sid, coalesce({by} IN (FROM buyer), false) AS converts,
         {_utm_select('page_location')}
  FROM visit v
)"""


# phone -> UTM rows, by rule: all rows that tie for the best of their group
_FIRST_PAID = f"""
choice AS (
  SELECT DISTINCT sid, phone_no, log_time, {_UTM4} FROM touch
  WHERE converts AND sid IS NOT NULL AND phone_no IS NOT NULL
  QUALIFY rank() OVER (PARTITION BY sid, phone_no
                       ORDER BY coalesce(utm_source = '!Non-Paid', false), log_time NULLS FIRST, utm_source NULLS FIRST) = 1
),
phone_utm AS (SELECT phone_no, {_UTM4} FROM choice WHERE utm_source IS NOT NULL AND log_time IS NOT NULL)"""


def _last_source(group: str, where: str = "") -> str:
    """The last source in text order; its other fields need every column of the group."""
    whole = " AND ".join(f"{g} IS NOT NULL" for g in [*group.split(", "), "utm_source"])
    rest = ", ".join(f"CASE WHEN {whole} THEN {c} END AS {c}" for c in _UTM4.split(", ")[1:])
    return f"""
choice AS (
  SELECT DISTINCT {group}, utm_source, {rest} FROM (
    SELECT * FROM touch {where} QUALIFY rank() OVER (PARTITION BY {group} ORDER BY utm_source DESC NULLS LAST) = 1)
),
phone_utm AS (SELECT phone_no, {_UTM4} FROM choice)"""


_LAST_BY_SESSION = _last_source("sid, phone_no", "WHERE converts AND phone_no IS NOT NULL")
_LAST_BY_SESSION_ALL = _last_source("sid, phone_no")
_LAST_BY_PHONE = _last_source("phone_no")

_WHOLE_TOUCH = " AND ".join(f"{c} IS NOT NULL" for c in ["sid", "phone_no", "log_time", *_UTM4.split(", ")])
_CONVERTED = f"""
choice AS (
  SELECT * FROM touch WHERE converts
  QUALIFY row_number() OVER (
    PARTITION BY sid, phone_no
    ORDER BY coalesce(utm_source = '!Non-Paid', false), log_time NULLS FIRST,
             {', '.join(f'{c} NULLS FIRST' for c in _UTM4.split(', '))}) = 1
),
phone_utm AS (
  SELECT phone_no, utm_source, log_time,
         {', '.join(f'CASE WHEN {_WHOLE_TOUCH} THEN {c} END AS {c}' for c in _UTM4.split(', ')[1:])}
  FROM choice
)"""


def _joined(dealer: bool = True, distinct: bool = True, extra: str = "") -> str:
    """``lead_utm``: every form with the UTM rows of its phone."""
    cols = _FORM + (", dealer_name" if dealer else "")
    return f"""
lead_utm AS (
  SELECT {'DISTINCT' if distinct else ''} {cols}, replace(utm_source, '!Non-Paid', 'Non-Paid') AS utm_source,
         utm_medium, utm_campaign, utm_content{extra}
  FROM form LEFT JOIN phone_utm ON phone_no = phone
)"""


def _new_only(rows: str, sink: str, days: int) -> str:
    after, before, _, _ = _window(days)
    same = " AND ".join(f"n.{k} = old.{k}" for k in ["fullname", "city", "phone", "email", "created_at", "car_name"])
    return f"SELECT n.* FROM {rows} n ANTI JOIN (FROM {sink} WHERE created_at > {after} AND created_at < {before}) old ON {same}"


_LATEST = f"""
latest AS (
  SELECT {_FORM}, {_UTM4} FROM lead_utm
  QUALIFY row_number() OVER (
    PARTITION BY {_FORM}
    ORDER BY log_time DESC NULLS LAST, {', '.join(f'{c} DESC NULLS LAST' for c in _UTM4.split(', '))}) = 1
)"""

# ------------------------------------------------------------------ oracles
def _journey() -> str:
    """``bridge``, ``journey``, and per active customer the list of types clicked."""
    end = dt.datetime.combine(C.JOURNEY_AS_OF.date(), dt.time(0))
    return f"""
bridge AS (
  SELECT coalesce(l.user_id, s.user_id) AS user_id, coalesce(l.customer_id, s.customer_id) AS customer_id
  FROM link l FULL JOIN (SELECT DISTINCT * FROM sign_in) s ON s.user_id = l.user_id
),
journey AS (
  SELECT customer_id, event_id, story_id, {_click_class('click_url')} AS tracking_type,
         click_url AS location_url, CAST(date_trunc('day', tracked_time) AS TIMESTAMP) AS tracked_date
  FROM clicks JOIN bridge USING (user_id)
  WHERE story_id = {_q(C.JOURNEY_STORY)} AND tracked_time >= {_ts(C.JOURNEY_START)} AND tracked_time <= {_ts(end)}
),
profile AS (
  SELECT customer_id, list(DISTINCT tracking_type) AS types FROM journey
  WHERE customer_id IN (SELECT customer_id FROM open_order) GROUP BY ALL
),
unknown AS (SELECT coalesce(list(DISTINCT tracking_type), []) AS types FROM journey WHERE customer_id IS NULL),
known_single AS (SELECT customer_id, types[1] AS tracking_type FROM profile WHERE len(types) = 1),
single AS (SELECT * FROM known_single WHERE len(list_filter((SELECT types FROM unknown), lambda t: t <> tracking_type)) = 0),
several AS (SELECT customer_id, 'Multiple Visit' AS tracking_type FROM profile WHERE len(types) > 1)"""


def _range(col: str, start, end, bounds: str) -> str:
    lo = ">=" if bounds[0] == "[" else ">"
    hi = "<=" if bounds[1] == "]" else "<"
    return f"{col} {lo} {_ts(start)} AND {col} {hi} {_ts(end)}"


def _active(source: str, start, end, bounds: str) -> str:
    return f"SELECT customer_id FROM {source} WHERE {_range('tracked_time', start, end, bounds)}"


def _any_active(start, end, bounds: str) -> str:
    return " UNION ".join(_active(t, start, end, bounds) for t in ("signed", "viewed", "clicked"))


def _recent(as_of: dt.date) -> str:
    since = _ts(as_of - dt.timedelta(days=C.FRESH_DAYS))
    return f"""
fresh AS (
  SELECT description, car_name, created_at, fullname, phone, email, city, estimated_buying_time, referer,
         CAST(count(*) OVER () AS VARCHAR) AS total_row
  FROM offer_leads WHERE created_at >= {since}
)"""


def _day_text(form: str) -> str:
    return f"strftime(strptime(event_date, '%Y%m%d'), '{form}')"


_PAID, _REGISTERED = "default_channel_grouping LIKE '%Paid%'", "contains(event_name, 'Registration Success')"
_UNPAID = "default_channel_grouping <> 'Paid Search/Display'"
_USER_SUMS = [
    ("total_users", "true"), ("paid_users", _PAID), ("non_paid_users", _UNPAID),
    ("membership_paid_users", f"{_PAID} AND {_REGISTERED}"),
    ("membership_non_paid_users", f"{_UNPAID} AND {_REGISTERED}"),
]


def build() -> dict[str, str]:
    o: dict[str, str] = {}
    # ---- column functions
    o["normalize_phone"] = _with(body=f"SELECT fullname, phone AS phone_raw, {_norm_phone('phone')} AS phone FROM td_leads")
    o["normalize_mapped_phone"] = _with(body=f"SELECT user_pseudo_id, phone_no, {_mapped_phone('phone_no')} AS phone_clean FROM phone_map")
    o["extract_utm_pages"] = f"SELECT page_id, {_utm_select('url')} FROM pages"
    o["extract_utm_events"] = _with(body=f"SELECT user_pseudo_id, event_timestamp, {_utm_select(_param('page_location'))} FROM ga_events")
    o["event_params"] = _with(body=f"""SELECT user_pseudo_id, event_timestamp, {_param('page_location')} AS page_location,
       {_param('ga_session_id', 'int_value')} AS ga_session_id, {_param('medium')} AS medium_param FROM ga_events""")
    o["classify_click_url"] = _with(body=f"SELECT event_id, click_url, {_click_class('click_url')} AS tracking_type FROM clicks")
    o["channel_grouping"] = _with(body=f"SELECT medium, {_channel('medium')} AS default_channel_grouping FROM (SELECT DISTINCT medium FROM ga_events)")

    # ---- leads
    days, short, long = C.LOOKBACK_DAYS, C.SHORT_LOOKBACK_DAYS, C.BROCHURE_LOOKBACK_DAYS
    o["load_leads"] = _with(_forms(days), body=f"SELECT {_FORM}, dealer_name FROM form")
    o["dedupe_leads"] = _with(_forms(days, brochure=True), body=f"SELECT {_FORM}, phone_raw FROM form")
    o["with_total_count"] = _with(body="""
SELECT description, car_name, created_at, fullname, (SELECT count(*) FROM offer_leads) AS data FROM offer_leads""")
    o["exclude_loaded"] = _with(_forms(days), body=_new_only(f"(SELECT {_FORM}, dealer_name FROM form)", "td_sink", days))
    after, before, first, last = _window(days)
    o["lookback_window"] = _with(body=f"""
SELECT {after} + INTERVAL 1 MICROSECOND AS lower_bound, {before} AS upper_bound, {first} AS event_day_from,
       {last} AS event_day_to, count(*) AS leads_in_window
FROM td_leads WHERE {_local('created_utc')} > {after} AND {_local('created_utc')} < {before}""")
    o["watermark_window"] = _with(body=f"SELECT {_WATERMARK} + INTERVAL 1 MICROSECOND AS lower_bound, {before} AS upper_bound")

    # ---- attribution steps
    drive = _visits(days, TEST_DRIVE)
    flag = "CASE WHEN {} THEN 'conv' ELSE 'null' END AS conv_flag"
    o["registered_events"] = _with(drive, body=f"""
SELECT user_pseudo_id, phone_no, log_time, page_location, sid AS ga_session_id,
       {flag.format(f"event_name = {_q(TEST_DRIVE)}")} FROM visit""")
    o["registered_events_bucketed"] = o["registered_events"]
    o["conversion_sessions_join"] = _with(drive, body=f"""
SELECT v.user_pseudo_id, phone_no, v.log_time, v.sid AS ga_session_id, v.page_location,
       CASE WHEN c.sid IS NOT NULL THEN 'conv' END AS conv_flag
FROM visit v LEFT JOIN (SELECT sid FROM web WHERE event_name = {_q(TEST_DRIVE)}) c ON c.sid = v.sid""")
    o["flag_conversion_sessions"] = _with(drive, body=f"""
SELECT user_pseudo_id, phone_no, log_time, sid AS ga_session_id, {flag.format('converts')}, {_UTM4} FROM touch""")
    for key, rule in [("best_source_per_phone", _LAST_BY_PHONE), ("best_source_per_session", _LAST_BY_SESSION),
                      ("best_source_per_session_all", _LAST_BY_SESSION_ALL), ("first_paid_touch", _FIRST_PAID)]:
        o[key] = _with(drive, rule, body="FROM phone_utm")
    brochure = [_forms(long, brochure=True), _visits(long, BROCHURE), _CONVERTED,
                _joined(dealer=False, extra=", log_time"), _LATEST]
    o["first_paid_touch_converted"] = _with(*brochure[1:3], body="FROM phone_utm")
    o["last_touch_per_lead"] = _with(*brochure, body="FROM latest")
    o["attribute_brochure"] = _with(*brochure, body=_new_only("latest", "br_sink", long))

    # ---- attribution end to end
    o["frequent_phones"] = _with(_forms(long), body="""
SELECT phone, count(*) AS leads FROM form WHERE phone IS NOT NULL GROUP BY phone
HAVING count(*) > 0.01 * (SELECT count(phone) FROM form)""")
    o["attribute_leads"] = _with(_forms(days), drive, _FIRST_PAID, _joined(), body="FROM lead_utm")
    for key, rule in [("attribute_test_drive", _FIRST_PAID), ("attribute_by_session", _LAST_BY_SESSION)]:
        o[key] = _with(_forms(days), drive, rule, _joined(), body=_new_only("lead_utm", "td_sink", days))
    sink_cols = f"{_FORM}, dealer_name, {_UTM4}"
    o["sink_after_load"] = _with(_forms(days), drive, _FIRST_PAID, _joined(), body=f"""
SELECT {sink_cols}, CAST(created_at AS DATE) AS created_date FROM
(SELECT {sink_cols} FROM td_sink UNION ALL BY NAME ({_new_only("lead_utm", "td_sink", days)}))""")
    o["sink_published"] = o["sink_after_load"]
    added = f"""SELECT 'first_paid_touch-' || strftime({after}, '%Y%m%dT%H%M%S') || '000000-' || strftime({before}, '%Y%m%dT%H%M%S') || '000000' AS batch_id,
  {after} AS window_from, {before} AS window_to, created_at FROM ({_new_only("lead_utm", "td_sink", days)})"""
    o["load_ledger"] = _with(_forms(days), drive, _FIRST_PAID, _joined(), body=f"""
SELECT batch_id, window_from, window_to, count(*) AS n_rows, min(created_at)::DATE AS first_day, max(created_at)::DATE AS last_day,
       count(*) AS rows_in_files
FROM (SELECT 'start' AS batch_id, NULL AS window_from, NULL AS window_to, created_at FROM td_sink UNION ALL {added}) GROUP BY ALL""")
    o["ledger_watermark"] = f"SELECT max(created_at) AS newest FROM ({o['sink_after_load']})"
    o["attribute_by_names"] = o["attribute_test_drive"]
    since = _forms(None)
    o["attribute_by_phone"] = _with(since, _visits(None, TEST_DRIVE), _LAST_BY_PHONE, _joined(distinct=False), body="FROM lead_utm")
    o["attribute_since_watermark"] = _with(since, _visits(None, TEST_DRIVE, anyone=True), _LAST_BY_SESSION_ALL, _joined(), body="FROM lead_utm")
    for key, how in [("attribute_by_session_unchecked", {}), ("attribute_joined_conversions", {"anyone": True}),
                     ("attribute_own_sessions", {"own": True})]:
        o[key] = _with(_forms(short), _visits(short, TEST_DRIVE, **how), _LAST_BY_SESSION, _joined(), body="FROM lead_utm")

    for key, full in [("touch_state_first_paid", "first_paid_touch"), ("touch_state_by_session", "attribute_by_session"),
                      ("touch_state_last_touch", "last_touch_per_lead")]:
        o[key] = o[full]  # the state gives what the full run over the events gives

    # ---- audience
    journey = _journey()
    o["identity_bridge"] = _with(journey, body="FROM bridge")
    o["journey_clicks"] = _with(journey, body="FROM journey")
    o["single_touch_users"] = _with(journey, body="FROM known_single")
    o["single_touch_users_unknown"] = _with(journey, body="FROM single")
    o["multi_touch_users"] = _with(journey, body="FROM several")
    o["segment_counts"] = _with(journey, body="""
SELECT tracking_type, count(*) AS total_active_user FROM (FROM single UNION ALL FROM several) GROUP BY ALL""")
    newest = max(k for k, day in enumerate(C.SNAPSHOT_DAYS) if day <= C.SNAPSHOT_AS_OF)
    o["snapshot_as_of"] = _with(body=f"""
SELECT customer_id, email, name, DATE '{C.SNAPSHOT_DAYS[newest]}' AS snapshot_date FROM customers WHERE customer_id::BIGINT % 5 <> {newest}""")
    o["not_in_subquery"] = _with(body="""
SELECT customer_id FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM signed WHERE customer_id IS NOT NULL)""")
    o["not_in_with_null"] = _with(body="""
SELECT customer_id FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM signed UNION ALL SELECT NULL)""")
    o["not_in_empty"] = _with(body="""
SELECT customer_id FROM (SELECT CASE WHEN customer_id::BIGINT % 4 > 0 THEN customer_id END AS customer_id FROM customers)
WHERE customer_id NOT IN (SELECT customer_id FROM signed WHERE customer_id = 'no such customer')""")
    signed = _active("signed", C.AUD_START, C.AUD_END, "[]")
    o["source_audience"] = _with(body=f"SELECT DISTINCT * FROM ({signed})")
    o["activity_on_day"] = _with(body=f"""
SELECT DISTINCT customer_id FROM signed WHERE strftime(tracked_time, '%Y-%m-%d') = '{C.ACTIVITY_DAY}'""")
    viewers = _active("viewed", C.AUD_START, C.AUD_END, "[]")
    o["signed_in_emails"] = _with(body=f"""
SELECT DISTINCT s.customer_id, v.email
FROM ({signed}) s LEFT JOIN (FROM customers SEMI JOIN ({viewers}) USING (customer_id)) v ON v.customer_id = s.customer_id""")
    o["emails_of_active"] = _with(body=f"SELECT DISTINCT email FROM customers WHERE customer_id IN ({signed})")
    o["active_any_left_key"] = _with(body=f"""
SELECT DISTINCT email, customer_id FROM customers WHERE customer_id IN ({_active('viewed', C.ANY_START, C.ANY_END, '()')})""")
    o["active_any"] = _with(body=f"""
SELECT customer_id FROM customers INTERSECT ({_any_active(C.ANY_START, C.ANY_END, '()')})""")
    o["inactive_emails"] = _with(body=f"""
SELECT DISTINCT email FROM customers ANTI JOIN ({_any_active(C.INACTIVE_START, C.INACTIVE_END, '[]')}) USING (customer_id)""")

    # ---- reports
    pages = "(SELECT *, unnest(event_params, recursive := false) AS entry FROM ga_events)"
    o["page_users_by_instant"] = _with(body=f"""
SELECT timestamp_date, hostname, page_location, CAST(user_pseudo_id IS NOT NULL AS BIGINT) AS total_users
FROM (SELECT DISTINCT make_timestamp(event_timestamp) AS timestamp_date, hostname, user_pseudo_id,
             entry.value.string_value AS page_location
      FROM {pages} WHERE entry.key = 'page_location')""")
    o["page_users_by_day"] = _with(body=f"""
SELECT timestamp_date, hostname, page_location, count(user_pseudo_id) AS total_users
FROM (SELECT DISTINCT {_day_text('%d-%m-%Y')} AS timestamp_date, hostname, user_pseudo_id,
             entry.value.string_value AS page_location
      FROM {pages} WHERE entry.key = 'page_location')
GROUP BY ALL""")
    o["monthly_users"] = _with(body=f"""
SELECT month_year, count(*) AS total_users
FROM (SELECT DISTINCT user_pseudo_id,
             strftime({_local("make_timestamp(event_timestamp + (user_id % 6) * 2592000000000)")}, '%Y-%m') AS month_year
      FROM ga_events)
GROUP BY ALL""")
    o["channel_users"] = _with(body=f"""
SELECT event_date, event_name, {_channel('medium')} AS default_channel_grouping,
       {', '.join(f"CAST(coalesce(sum(n) FILTER ({cond}), 0) AS BIGINT) AS {name}" for name, cond in _USER_SUMS)}
FROM (SELECT event_date, event_name, medium, count(*) AS n
      FROM (SELECT DISTINCT event_date, event_name, medium, user_pseudo_id FROM ga_events) GROUP BY ALL)
GROUP BY ALL""")
    o["monthly_users_sketched"] = f"SELECT month_year, total_users, true AS within_bound FROM ({o['monthly_users']})"
    o["channel_users_sketched"] = f"""SELECT event_date, event_name, default_channel_grouping, total_users, true AS within_bound
FROM ({o['channel_users']})"""
    wanted = " OR ".join(f"(starts_with(event_date, '{p}') AND event_date >= '{low}')" for p, low in C.EVENT_LOG_RANGES)
    o["event_log_between"] = _with(body=f"""
SELECT {_day_text('%d-%m-%Y')} AS event_date, user_pseudo_id, event_name FROM ga_events WHERE {wanted}""")
    o["traffic_sources"] = _with(body=f"""
SELECT DISTINCT medium AS traffic_source_medium, {_param('medium')} AS medium_param, manual_medium,
       gclid AS source_gclid, dclid AS source_dclid, srsltid AS source_srsltid FROM ga_events""")
    o["ad_date_parts"] = _with(body="""
SELECT DISTINCT date, date_part('year', date)::INTEGER AS year, date_part('month', date)::INTEGER AS month,
       date_part('day', date)::INTEGER AS day, campaign_name, frequency, date AS min_date
FROM ad JOIN ad_frequency USING (date) WHERE impressions > 19""")
    o["city_orders"] = _with(body="""
SELECT city, CAST(sum("order") AS BIGINT) AS total_order, min(order_id) AS first_order
FROM shop_orders NATURAL JOIN shop_customer GROUP BY ALL""")
    first_users = " UNION ALL ".join(
        f"SELECT {_day_text('%Y-%m-%d')} AS event_date, event_name, {_param('page_location')} AS page_location, "
        f"min(user_pseudo_id) AS user_id FROM ga_events WHERE starts_with(event_date, '{p}') GROUP BY ALL"
        for p in C.FIRST_USER_PREFIXES
    )
    o["first_user_per_page"] = _with(body=first_users)
    o["daily_page_class"] = _with(body=f"""
SELECT {_day_text('%Y-%m-%d')} AS event_date, max({_page_class(_param('page_location'))}) AS type_of_car
FROM ga_events WHERE starts_with(event_date, '{C.PAGE_CLASS_PREFIX}') GROUP BY ALL""")
    o["value_at_max_key_below"] = _with(body=f"""
SELECT round(LONG_W, 4) AS long_w FROM station WHERE LAT_N < {C.STATION_BOUND}
QUALIFY rank() OVER (ORDER BY LAT_N DESC) = 1""")
    o["campaign_totals_on_rows"] = _with(body=f"""
SELECT date, campaign_name, impressions, clicks_all,
       CAST(sum(impressions) OVER (PARTITION BY campaign_name) AS BIGINT) AS sum_impressions,
       count(impressions) OVER (PARTITION BY campaign_name) AS count_impressions
FROM ad WHERE date >= DATE '{C.ADS_START}' AND date <= DATE '{C.ADS_END}' AND campaign_name IS NOT NULL""")
    lc = " UNION ALL ".join(
        f"SELECT {_q(name)} AS lead_type, COUNT(*) AS lead_count FROM matched_{i} "
        f"WHERE utm_campaign = {_q(C.LEAD_CAMPAIGN)} AND created_at BETWEEN {_ts(C.LEAD_START)} AND {_ts(C.LEAD_END)}"
        for i, (name, _) in enumerate(FX.LEAD_TYPE_EVENTS)
    )
    o["lead_counts"] = _with(body=lc)
    o["find_customers"] = _with(body="SELECT email, name FROM customers WHERE email LIKE '%%'")
    o["campaign_list"] = _with(body="SELECT destination_id, status, label_ids, c_user_id, channel_name, end_date, ctime FROM campaign")
    o["pageview_users"] = _with(body="SELECT user_id FROM page_view")
    o["sample_users"] = _with(body=f"SELECT name FROM customers ORDER BY name LIMIT {C.SAMPLE_N}")

    # ---- quality
    for key, as_of in [("freshness_check", C.FRESH_AS_OF), ("freshness_check_stale", C.STALE_AS_OF)]:
        o[key] = _with(_recent(as_of), body="""
SELECT * FROM fresh
UNION ALL BY NAME
SELECT 'There is no data' AS total_row WHERE (SELECT count(*) FROM fresh) = 0""")
    o["freshness_status"] = _with(_recent(C.FRESH_AS_OF), body="SELECT count(*) > 0 AS fresh, count(*) AS recent_rows FROM fresh")
    o["freshness_assertion"] = _with(_recent(C.FRESH_AS_OF), body="""
SELECT 'stale' AS failed WHERE (SELECT count(*) FROM fresh) = 0""")
    return o


ORACLES = build()
