"""The SQL of an independent engine (DuckDB) for the library's queries, from the same public formulas."""

from __future__ import annotations

#: Line items as observations with made-up positions, by integers so that both engines agree.
_PLACED = """l_orderkey * 8 + l_linenumber AS source_id,
  ((l_orderkey * 7919 + l_linenumber * 104729) % 360000) / 1000e0 + 0.00037e0 AS lon,
  ((l_partkey * 15485863 + l_linenumber * 32452843) % 180000) / 1000e0 - 90e0 + 0.00029e0 AS lat,
  l_extendedprice AS v, l_quantity AS w, l_returnflag AS flag FROM lineitem"""
ALL = f"SELECT {_PLACED}"

#: Of rows with equal ids the first in the file.
OBS = f"SELECT * EXCLUDE (place) FROM (SELECT row_number() OVER () AS place, {_PLACED}) QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY place) = 1"


def micro(c: str, name: str | None = None) -> str:
    return f"CAST(floor(({c}) * 1e4 + 0.377e0) AS BIGINT) AS {name or c}"


def spread(c: str, bits: int) -> str:
    return " + ".join(f"((({c}) >> {i}) & 1) * {4**i}" for i in range(bits)) or "0"


def compact(c: str, bits: int) -> str:
    return " + ".join(f"((({c}) >> {2 * i}) & 1) * {2**i}" for i in range(bits)) or "0"


def faces(src: str, n: int) -> str:
    """The face and the place in it of each point."""
    return f"""SELECT * EXCLUDE (z, t, q, k, jp, jm, kp, km),
      CASE WHEN abs(z) <= 2e0/3e0 THEN CASE WHEN jp // {n} = jm // {n} THEN (jp // {n}) | 4 WHEN jp // {n} < jm // {n} THEN jp // {n} ELSE jm // {n} + 8 END
           WHEN z >= 0 THEN q ELSE q + 8 END AS face,
      CASE WHEN abs(z) <= 2e0/3e0 THEN jm % {n} WHEN z >= 0 THEN {n - 1} - km ELSE kp END AS ix,
      CASE WHEN abs(z) <= 2e0/3e0 THEN {n - 1} - jp % {n} WHEN z >= 0 THEN {n - 1} - kp ELSE km END AS iy
    FROM (SELECT *, CAST(floor({n}e0 * (0.5e0 + t) - {n}e0 * z * 0.75e0) AS BIGINT) AS jp, CAST(floor({n}e0 * (0.5e0 + t) + {n}e0 * z * 0.75e0) AS BIGINT) AS jm,
            least({n - 1}, CAST(floor((t - q) * k) AS BIGINT)) AS kp, least({n - 1}, CAST(floor((1e0 - (t - q)) * k) AS BIGINT)) AS km
          FROM (SELECT *, cos(radians(90e0 - lat)) AS z, lon / 90e0 AS t, least(3, CAST(floor(lon / 90e0) AS BIGINT)) AS q,
                  {n}e0 * sqrt(3e0 * (1e0 - abs(cos(radians(90e0 - lat))))) AS k FROM ({src})))"""


def cells(src: str, n: int) -> str:
    bits = n.bit_length() - 1
    return f"SELECT * EXCLUDE (face, ix, iy), CAST(face * {n * n} + ({spread('ix', bits)}) + 2 * ({spread('iy', bits)}) AS BIGINT) AS healpix_id FROM ({faces(src, n)})"


def ring(src: str, n: int) -> str:
    """Ring numbers from face, ix and iy."""
    return f"""SELECT * EXCLUDE (face, ix, iy, jr, jt, nr, ks, jp), CAST(CASE WHEN jr < {n} THEN 2 * nr * (nr - 1) WHEN jr > {3 * n} THEN {12 * n * n} - 2 * (nr + 1) * nr ELSE {2 * n * (n - 1)} + (jr - {n}) * {4 * n} END
        + CASE WHEN jp > {4 * n} THEN jp - {4 * n} WHEN jp < 1 THEN jp + {4 * n} ELSE jp END - 1 AS BIGINT) AS ring_id
      FROM (SELECT *, (jt * nr + ix - iy + 1 + ks) // 2 AS jp
      FROM (SELECT *, CASE WHEN jr < {n} THEN jr WHEN jr > {3 * n} THEN {4 * n} - jr ELSE {n} END AS nr, CASE WHEN jr < {n} OR jr > {3 * n} THEN 0 ELSE (jr - {n}) & 1 END AS ks
      FROM (SELECT *, (2 + face // 4) * {n} - ix - iy - 1 AS jr, [1,3,5,7,0,2,4,6,1,3,5,7][face + 1] AS jt FROM ({src}))))"""


def corner(a: int, b: int, n: int) -> tuple[str, str]:
    """Longitude and latitude of a corner, from face, ix and iy."""
    u, v = f"((ix + {0.5 + a / 2}e0) / {n}e0)", f"((iy + {0.5 + b / 2}e0) / {n}e0)"
    j = f"((2 + face // 4) - {u} - {v})"
    nr = f"(CASE WHEN {j} < 1 THEN {j} WHEN {j} > 3 THEN 4e0 - {j} ELSE 1e0 END)"
    z = f"(CASE WHEN {j} < 1 THEN 1e0 - {nr} * {nr} / 3e0 WHEN {j} > 3 THEN {nr} * {nr} / 3e0 - 1e0 ELSE (2e0 - {j}) * 2e0 / 3e0 END)"
    t0 = f"([1,3,5,7,0,2,4,6,1,3,5,7][face + 1] * {nr} + {u} - {v})"
    t = f"({t0} - 8e0 * floor({t0} / 8e0))"
    phi = f"(CASE WHEN {nr} < 1e-15 THEN 0e0 ELSE pi() / 4e0 * {t} / {nr} END)"
    lon = f"(degrees({phi}) - 360e0 * floor(degrees({phi}) / 360e0))"
    return lon, f"(90e0 - degrees(acos(greatest(-1e0, least(1e0, {z})))))"


CORNERS = ((1, 1), (-1, 1), (-1, -1), (1, -1))


def grid(n: int) -> str:
    bits = n.bit_length() - 1
    return f"SELECT range AS healpix_id, range // {n * n} AS face, {compact(f'(range % {n * n})', bits)} AS ix, {compact(f'((range % {n * n}) >> 1)', bits)} AS iy FROM range({12 * n * n})"


def corners(n: int) -> str:
    parts = []
    for k, (a, b) in enumerate(CORNERS):
        lon, lat = corner(a, b, n)
        parts += [f"{lon} AS lon_{k}", f"{lat} AS lat_{k}"]
    return f"SELECT healpix_id, {', '.join(parts)} FROM ({grid(n)})"


def stats(src: str, columns: list[str], key: str = "healpix_id", least: int = 1) -> str:
    """mean, median, std, min, max, mad and robust_std of columns, in micro units, and the number of rows."""
    made, out = [], []
    for c in columns:
        made += [f"avg({c}) AS {c}_mean", f"median({c}) AS {c}_median", f"stddev_pop({c}) AS {c}_std", f"min({c}) AS {c}_min", f"max({c}) AS {c}_max", f"mad({c}) AS {c}_mad"]
        out += [f"CASE WHEN n_sources >= {least} THEN {micro(f'{c}_{a}', '').replace(' AS ', '~').rpartition('~')[0].replace('~', ' AS ')} END AS {c}_{a}" for a in ("mean", "median", "std", "min", "max", "mad")]
        out.append(f"CASE WHEN n_sources >= {least} THEN CAST(floor({c}_mad * 1.4826e0 * 1e4 + 0.377e0) AS BIGINT) END AS {c}_robust_std")
    return f"SELECT {key}, {', '.join(out)}, n_sources FROM (SELECT {key}, {', '.join(made)}, count(*) AS n_sources FROM ({src}) GROUP BY {key})"
