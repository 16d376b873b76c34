"""SQL twins of the derived sample tables, shared by the oracle queries."""

LAT = "(CASE slot % 3 WHEN 0 THEN 1.3e0 WHEN 1 THEN 35.68e0 ELSE 13.75e0 END)"
LNG = "(CASE slot % 3 WHEN 0 THEN 103.8e0 WHEN 1 THEN 139.69e0 ELSE 100.5e0 END)"


def cell_sql(lat: str, lng: str, level: int = 21) -> str:
    top = (1 << level) - 1
    x = f"greatest(least(CAST(floor(({lng} + 180e0) / 360e0 * {1 << level}e0) AS BIGINT), {top}), 0)"
    y = f"greatest(least(CAST(floor(({lat} + 90e0) / 180e0 * {1 << level}e0) AS BIGINT), {top}), 0)"
    return f"(({level}::BIGINT * 4398046511104) + {x} * 2097152 + {y})"


def parent_sql(cell: str, level: int) -> str:
    """Parent of a level-21 cell."""
    shift = 1 << (21 - level)
    x = f"(({cell} // 2097152) % 2097152)"
    y = f"({cell} % 2097152)"
    return f"(({level}::BIGINT * 4398046511104) + ({x} // {shift}) * 2097152 + {y} // {shift})"


MEDIA = f"""
ev AS (SELECT *, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS k FROM events),
ev2 AS (SELECT *, k % 27 AS slot, value - floor(value) AS part FROM ev),
media0 AS (
  SELECT event_id AS media_id, user_id AS track_id, 'IMG_' || event_id || '.jpg' AS file_name,
    ts AS taken_at,
    CASE WHEN event_id % 7 <> 0 THEN
      CASE slot % 3 WHEN 0 THEN 'Asia/Singapore' WHEN 1 THEN 'Asia/Tokyo' ELSE 'Asia/Bangkok' END
    END AS timezone,
    CAST(ts + to_hours(CASE WHEN event_id % 7 = 0 THEN 0 WHEN slot % 3 = 0 THEN 8
                            WHEN slot % 3 = 1 THEN 9 ELSE 7 END) AS DATE) AS local_date,
    CASE WHEN k % 29 <> 0 THEN {LAT} + 0.15e0 * slot + 0.01e0 * part END AS latitude,
    CASE WHEN k % 29 <> 0 THEN {LNG} + 0.01e0 * part END AS longitude,
    'cell_' || slot AS geo_cell,
    CASE WHEN event_id % 3 <> 0 THEN
      (CASE WHEN event_id % 5 <> 0 THEN 'https://photos.google.com/photo/'
            ELSE 'https://example.org/p/' END) || event_id END AS url
  FROM ev2),
media AS (SELECT *, CASE WHEN latitude IS NOT NULL THEN {cell_sql("latitude", "longitude")} END
  AS base_cell FROM media0)"""

PLACE = """
place AS (
  SELECT 'cell_' || n_nationkey AS cell_id,
    CASE n_nationkey % 3 WHEN 0 THEN 'SG' WHEN 1 THEN 'JP' ELSE 'TH' END AS country_code,
    CASE WHEN n_nationkey <> 5 THEN n_name END AS city,
    CASE WHEN n_nationkey IN (1, 4) THEN ' Tokyo ' ELSE 'ADM_' || (n_nationkey % 3) END AS admin1
  FROM nation)"""

LABEL = """CASE WHEN cc = 'JP' AND trim(admin1) = 'Tokyo' THEN 'Tokyo'
    ELSE coalesce(nullif(city, ''), nullif(trim(admin1), '')) END"""


def points_sql(start: str | None = None, end: str | None = None, region: str = "") -> str:
    window = f"AND taken_at >= '{start}' AND taken_at < '{end}'" if start else ""
    return f"""{MEDIA}, {PLACE},
points AS (
  SELECT track_id, media_id, taken_at AS t, epoch_us(taken_at) AS us, local_date,
    latitude AS lat, longitude AS lng, country_code AS cc, city, admin1, url,
    row_number() OVER (PARTITION BY track_id ORDER BY taken_at, media_id) AS seq
  FROM media LEFT JOIN place ON geo_cell = cell_id
  WHERE latitude IS NOT NULL {window} {region})"""


MEAN = "CAST(round(CAST(round({total} / {n}, 10) AS DECIMAL(18, 10)), 5) AS DOUBLE)"


def mean_sql(total: str, n: str = "n") -> str:
    return MEAN.format(total=total, n=n)


def runs_sql(source: str, key: str, by: str = "track_id", out: str = "runs") -> str:
    """Runs of equal key over item rows in (us, media_id) order."""
    return f"""
{out}_a AS (SELECT *, {key} AS rk, row_number() OVER (PARTITION BY {by} ORDER BY us, media_id) AS rn
  FROM {source}),
{out}_b AS (SELECT *, CASE WHEN lag(rk) OVER (PARTITION BY {by} ORDER BY rn) = rk THEN 0 ELSE 1 END
  AS brk FROM {out}_a),
{out}_c AS (SELECT *, sum(brk) OVER (PARTITION BY {by} ORDER BY rn) AS run FROM {out}_b),
{out} AS (SELECT {by}, run, min(rk) AS key, min(us) AS f, max(us) AS l,
  arg_min(CAST(media_id AS VARCHAR), rn) AS fi, arg_max(CAST(media_id AS VARCHAR), rn) AS li,
  arg_min(local_date, rn) AS fd, arg_max(local_date, rn) AS ld,
  sum(lat) AS slat, sum(lng) AS slng, count(*) AS n,
  arg_min(url, rn) FILTER (WHERE url IS NOT NULL) AS u
  FROM {out}_c GROUP BY {by}, run)"""


def smooth_sql(runs: str, hours: str = "24", by: str = "track_id", out: str = "smooth") -> str:
    """The stack pass as a recursion over the runs of each sequence."""
    cols = [c.strip() for c in by.split(",")]
    join = " AND ".join(f"x.{c} = r.{c}" for c in cols)
    mine = ", ".join(f"r.{c}" for c in cols)
    item = "{'key': key, 'f': f, 'l': l, 'fi': fi, 'li': li, 'fd': fd, 'ld': ld, 'slat': slat, 'slng': slng, 'n': n, 'u': u}"
    xitem = item
    for c in ("key", "f", "l", "fi", "li", "fd", "ld", "slat", "slng", "n", "u"):
        xitem = xitem.replace(f"'{c}': {c}", f"'{c}': x.{c}")
    fused = (
        "{'key': x.key, 'f': st[-2].f, 'l': x.l, 'fi': st[-2].fi, 'li': x.li, 'fd': st[-2].fd, "
        "'ld': x.ld, 'slat': st[-2].slat + st[-1].slat + x.slat, "
        "'slng': st[-2].slng + st[-1].slng + x.slng, 'n': st[-2].n + st[-1].n + x.n, "
        "'u': coalesce(st[-2].u, st[-1].u, x.u)}"
    )
    return f"""
{out}_r AS (
  SELECT {by}, CAST(1 AS BIGINT) AS i, [{item}] AS st FROM {runs} WHERE run = 1
  UNION ALL
  SELECT {mine}, i + 1,
    CASE WHEN len(st) >= 2 AND st[-1].l - st[-1].f < {hours} * 3600000000 AND st[-2].key = x.key
      THEN list_append(st[1:len(st) - 2], {fused}) ELSE list_append(st, {xitem}) END
  FROM {out}_r r JOIN {runs} x ON {join} AND x.run = r.i + 1),
{out}_l AS (SELECT {by}, st FROM {out}_r QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY i DESC) = 1),
{out} AS (SELECT {by}, s.key AS key, s.f AS f, s.l AS l, s.fi AS fi, s.li AS li, s.fd AS fd,
  s.ld AS ld, s.slat AS slat, s.slng AS slng, s.n AS n, s.u AS u
  FROM (SELECT {by}, unnest(st) AS s FROM {out}_l))"""


def stays_select(source: str, by: str = "track_id") -> str:
    return f"""SELECT {by}, key AS label, CAST(fd AS VARCHAR) AS "from", CAST(ld AS VARCHAR) AS "to",
  {mean_sql("slat")} AS lat, {mean_sql("slng")} AS lng, CAST(n AS BIGINT) AS photo_count,
  u AS sample_url FROM {source}"""


def leader_sql(source: str, km: str = "50", by: str = "track_id", out: str = "clus") -> str:
    """Running-centroid clustering as a recursion over the items of each sequence."""
    cols = [c.strip() for c in by.split(",")]
    join = " AND ".join(f"x.{c} = r.{c}" for c in cols)
    xs = ", ".join(f"x.{c}" for c in cols)
    h = (
        "2 * 6371.0e0 * asin(sqrt(least(1e0, pow(sin(radians(x.lat - cla) / 2), 2) + "
        "cos(radians(cla)) * cos(radians(x.lat)) * pow(sin(radians(x.lng - clo) / 2), 2))))"
    )
    return f"""
{out}_i AS (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY us, media_id) AS rn FROM {source}),
{out}_r AS (
  SELECT {by}, media_id, rn, CAST(media_id AS VARCHAR) AS cid, lat AS cla, lng AS clo, 1 AS cn
  FROM {out}_i WHERE rn = 1
  UNION ALL
  SELECT {xs}, x.media_id, x.rn,
    CASE WHEN {h} <= {km} THEN cid ELSE CAST(x.media_id AS VARCHAR) END,
    CASE WHEN {h} <= {km} THEN cla + (x.lat - cla) / (cn + 1) ELSE x.lat END,
    CASE WHEN {h} <= {km} THEN clo + (x.lng - clo) / (cn + 1) ELSE x.lng END,
    CASE WHEN {h} <= {km} THEN cn + 1 ELSE 1 END
  FROM {out}_r r JOIN {out}_i x ON {join} AND x.rn = r.rn + 1),
{out} AS (SELECT p.*, r.cid FROM {out}_i p JOIN {out}_r r USING ({by}, media_id))"""


def modal_sql(source: str, by: str = "track_id", out: str = "modal") -> str:
    """Most common label per cluster, ties to the one seen first."""
    return f"""
{out}_c AS (SELECT {by}, cid, label, count(*) AS c, min(rn) AS seen FROM {source} GROUP BY {by}, cid, label),
{out} AS (SELECT {by}, cid, label FROM {out}_c
  QUALIFY row_number() OVER (PARTITION BY {by}, cid ORDER BY c DESC, seen) = 1)"""
