"""The HEALPix tessellation as Spark expressions: cells of points, corners, numberings and parents.

Formulas from the public definition (Gorski et al. 2005). Every step is a built-in expression in a layer of its own,
so the work stays in generated code and no subtree is written twice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Of the twelve base faces, the ring and the longitude (in units of 45 degrees) of their southern corner.
FACE_RING = (2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4)
FACE_TURN = (1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7)
ORDERS = ("nested", "ring")


def check_nside(nside: int) -> int:
    """nside, if it is a power of two of at least 1, else ValueError."""
    if not is_nside(nside):
        raise ValueError(f"nside must be a power of two of at least 1, not {nside!r}")
    return int(nside)


def is_nside(nside: object) -> bool:
    return isinstance(nside, int) and not isinstance(nside, bool) and nside >= 1 and nside & (nside - 1) == 0


def check_order(order: str) -> str:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {ORDERS}, not {order!r}")
    return order


def npix_of(nside: int) -> int:
    return 12 * nside * nside


def nside_of(npix: int) -> int:
    nside = round((npix / 12) ** 0.5)
    if npix < 12 or npix_of(nside) != npix or not is_nside(nside):
        raise ValueError(f"{npix} is not a number of cells")
    return nside


def cell_diameter(nside: int) -> float:
    """The diameter, in degrees, of the circle with a cell's area."""
    import math

    area = 4 * math.pi / npix_of(nside)
    return math.degrees(2 * math.sqrt(area / math.pi))


def _bits(nside: int) -> int:
    return nside.bit_length() - 1


def _halves(bits: int) -> list[tuple[int, int]]:
    """For numbers of so many bits, the widths of the groups that move apart, widest first, and what they leave."""
    widths = [w for w in (16, 8, 4, 2, 1) if w < bits]
    return [(w, sum(((1 << w) - 1) << k for k in range(0, 64, 2 * w)) & ((1 << 63) - 1)) for w in widths]


def spread(df: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Bit i of each of the columns at place 2i. Half of the bits move at once, so the generated code stays short."""
    for width, mask in _halves(bits):
        df = df.withColumns({c: F.expr(f"({c} | shiftleft({c}, {width})) & {mask}L") for c in names})
    return df


def compact(df: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Bit 2i of each of the columns at place i; bits at odd places are lost."""
    df = df.withColumns({c: F.expr(f"{c} & {0x5555555555555555 & (1 << 2 * bits) - 1}L") for c in names})
    for width, _ in reversed(_halves(bits)):
        mask = sum(((1 << 2 * width) - 1) << k for k in range(0, 64, 4 * width)) & ((1 << 63) - 1)
        df = df.withColumns({c: F.expr(f"({c} | shiftright({c}, {width})) & {mask}L") for c in names})
    return df


def _drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*names)


def with_cell(df: DataFrame, lon: str | Column, lat: str | Column, nside: int, order: str = "nested", name: str = "healpix_id", known: bool = False) -> DataFrame:
    """Adds the cell of each point; null where a coordinate is null or not finite, or the latitude beyond a pole.

    known: the caller has filtered such points out. The cell is then never null, so that no later join or filter sends
    a null test, with the whole expression in it, down to the scan.
    """
    n = check_nside(nside)
    check_order(order)
    lon = F.col(lon) if isinstance(lon, str) else lon
    lat = F.col(lat) if isinstance(lat, str) else lat
    finite = lambda c: c.cast("double") if known else F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c.cast("double"))
    df = df.withColumns({"_lon": finite(lon), "_lat": finite(lat) if known else F.when(F.abs(lat) <= 90, finite(lat))})
    df = df.selectExpr("*", "cos(radians(90D - _lat)) AS _z", "pmod(_lon, 360D) / 90D AS _t0").selectExpr("*", "if(_t0 >= 4D, 0D, _t0) AS _t", "abs(_z) AS _za", f"{n}D * sqrt(3D * (1D - abs(_z))) AS _w")
    df = df.selectExpr(
        "*",
        "_za <= 2D / 3D AS _belt",
        f"cast(floor({n}D * (0.5D + _t) - {n}D * _z * 0.75D) AS long) AS _jp",
        f"cast(floor({n}D * (0.5D + _t) + {n}D * _z * 0.75D) AS long) AS _jm",
        "least(3L, cast(floor(_t) AS long)) AS _q",
    ).selectExpr(
        "*",
        f"_jp div {n} AS _fp",
        f"_jm div {n} AS _fm",
        f"least({n - 1}L, cast(floor((_t - _q) * _w) AS long)) AS _kp",
        f"least({n - 1}L, cast(floor((1D - (_t - _q)) * _w) AS long)) AS _km",
    )
    df = df.selectExpr(
        "*",
        "if(_belt, if(_fp = _fm, _fp | 4L, if(_fp < _fm, _fp, _fm + 8L)), if(_z >= 0D, _q, _q + 8L)) AS _face",
        f"if(_belt, _jm & {n - 1}L, if(_z >= 0D, {n - 1}L - _km, _kp)) AS _x",
        f"if(_belt, {n - 1}L - (_jp & {n - 1}L), if(_z >= 0D, {n - 1}L - _kp, _km)) AS _y",
    )
    helpers = ["_lon", "_lat", "_z", "_t0", "_t", "_za", "_w", "_belt", "_jp", "_jm", "_q", "_fp", "_fm", "_kp", "_km", "_face", "_x", "_y"]
    if order == "nested":
        df = spread(df, ["_x", "_y"], _bits(n)).withColumn("_id", F.expr(f"_face * {n * n}L + _x + 2L * _y"))
    else:
        df = _ring_from_face(df, n, "_id")
    cell = "coalesce(_id, -1L)" if known else "if(_lon IS NOT NULL AND _lat IS NOT NULL, _id, NULL)"
    return _drop(df.withColumn(name, F.expr(cell)), *helpers, "_id")


def _table(values: tuple[int, ...], c: str) -> str:
    return f"element_at(array({', '.join(f'{v}L' for v in values)}), cast({c} AS int) + 1)"


def _ring_from_face(df: DataFrame, n: int, name: str) -> DataFrame:
    """The ring number from _face, _x and _y; a null face gives null."""
    df = df.withColumn("_fr", F.expr(f"if(_face IS NULL, NULL, {_table(FACE_RING, '_face')}) * {n}L - _x - _y - 1L")).withColumn("_ft", F.expr(f"if(_face IS NULL, NULL, {_table(FACE_TURN, '_face')})"))
    df = df.selectExpr(
        "*",
        f"CASE WHEN _fr < {n} THEN _fr WHEN _fr > {3 * n} THEN {4 * n}L - _fr ELSE {n}L END AS _nr",
        f"CASE WHEN _fr < {n} OR _fr > {3 * n} THEN 0L ELSE (_fr - {n}L) & 1L END AS _ks",
    )
    df = df.selectExpr(
        "*",
        f"CASE WHEN _fr < {n} THEN 2L * _nr * (_nr - 1L) WHEN _fr > {3 * n} THEN {12 * n * n}L - 2L * (_nr + 1L) * _nr ELSE {2 * n * (n - 1)}L + (_fr - {n}L) * {4 * n}L END AS _nb",
        "(_ft * _nr + _x - _y + 1L + _ks) div 2 AS _p0",
    )
    df = df.withColumn(name, F.expr(f"_nb + (CASE WHEN _p0 > {4 * n} THEN _p0 - {4 * n}L WHEN _p0 < 1 THEN _p0 + {4 * n}L ELSE _p0 END) - 1L"))
    return _drop(df, "_fr", "_ft", "_nr", "_ks", "_nb", "_p0")


def with_face(df: DataFrame, cell: str, nside: int, order: str = "nested") -> DataFrame:
    """Adds _face, _x and _y of each cell."""
    n = check_nside(nside)
    check_order(order)
    if order == "nested":
        df = df.selectExpr("*", f"`{cell}` div {n * n} AS _face", f"`{cell}` % {n * n} AS _in")
        return compact(df.withColumns({"_x": F.col("_in"), "_y": F.shiftright("_in", 1)}).drop("_in"), ["_x", "_y"], _bits(n))
    cap, all_ = 2 * n * (n - 1), npix_of(n)
    root = lambda c: f"cast(floor((1D + floor(sqrt(cast({c} AS double) + 0.5D))) / 2D) AS long)"
    df = df.selectExpr("*", f"CASE WHEN `{cell}` < {cap} THEN 0 WHEN `{cell}` < {all_ - cap} THEN 1 ELSE 2 END AS _zone")
    df = df.selectExpr(
        "*",
        f"CASE _zone WHEN 0 THEN {root(f'1 + 2 * `{cell}`')} WHEN 1 THEN (`{cell}` - {cap}) div {4 * n} + {n}L ELSE {root(f'2 * ({all_} - `{cell}`) - 1')} END AS _ir",
    )
    df = df.selectExpr(
        "*",
        f"CASE _zone WHEN 0 THEN `{cell}` + 1 - 2 * _ir * (_ir - 1) WHEN 1 THEN (`{cell}` - {cap}) % {4 * n} + 1 ELSE 4 * _ir + 1 - ({all_} - `{cell}` - 2 * _ir * (_ir - 1)) END AS _ip",
        f"if(_zone = 1, {n}L, _ir) AS _nr",
        f"if(_zone = 1, (_ir + {n}) & 1L, 0L) AS _ks",
    )
    df = df.selectExpr("*", f"(_ip - (_ir - {n} + 1) div 2 + {n} - 1) div {n} AS _fm", f"(_ip - ({2 * n + 1} - (_ir - {n})) div 2 + {n} - 1) div {n} AS _fp")
    df = df.selectExpr("*", "CASE _zone WHEN 0 THEN (_ip - 1) div _nr WHEN 1 THEN if(_fp = _fm, _fp | 4L, if(_fp < _fm, _fp, _fm + 8L)) ELSE 8L + (_ip - 1) div _nr END AS _face", f"if(_zone = 2, {4 * n}L - _ir, _ir) AS _ring")
    df = df.selectExpr("*", f"_ring - {_table(FACE_RING, '_face')} * {n}L + 1L AS _rt", f"2L * _ip - {_table(FACE_TURN, '_face')} * _nr - _ks - 1L AS _p0")
    df = df.selectExpr("*", f"if(_p0 >= {2 * n}, _p0 - {8 * n}L, _p0) AS _pt")
    df = df.selectExpr("*", "shiftright(_pt - _rt, 1) AS _x", "shiftright(-_pt - _rt, 1) AS _y")
    return _drop(df, "_zone", "_ir", "_ip", "_nr", "_ks", "_fm", "_fp", "_ring", "_rt", "_p0", "_pt")


def nested_to_ring(df: DataFrame, cell: str, nside: int, name: str) -> DataFrame:
    return _drop(_ring_from_face(with_face(df, cell, nside), nside, name), "_face", "_x", "_y")


def ring_to_nested(df: DataFrame, cell: str, nside: int, name: str) -> DataFrame:
    df = with_face(df, cell, nside, "ring")
    df = spread(df, ["_x", "_y"], _bits(nside))
    return _drop(df.withColumn(name, F.expr(f"_face * {nside * nside}L + _x + 2L * _y")), "_face", "_x", "_y")


#: A cell's corners in units of half its side, in the order north, west, south, east.
CORNERS = ((1, 1), (-1, 1), (-1, -1), (1, -1))


def with_corners(df: DataFrame, cell: str, nside: int, order: str = "nested") -> DataFrame:
    """Adds theta_0..3 and phi_0..3, the colatitude and longitude of the corners in radians."""
    df = with_face(df, cell, nside, order)
    df = df.selectExpr("*", f"{_table(FACE_RING, '_face')} AS _fr", f"{_table(FACE_TURN, '_face')} AS _ft")
    for k, (a, b) in enumerate(CORNERS):
        df = df.selectExpr("*", f"(_x + {0.5 + a / 2}D) / {nside}D AS _u", f"(_y + {0.5 + b / 2}D) / {nside}D AS _v")
        df = df.selectExpr("*", "_fr - _u - _v AS _j")
        df = df.selectExpr("*", "CASE WHEN _j < 1D THEN _j WHEN _j > 3D THEN 4D - _j ELSE 1D END AS _nr")
        df = df.selectExpr("*", "CASE WHEN _j < 1D THEN 1D - _nr * _nr / 3D WHEN _j > 3D THEN _nr * _nr / 3D - 1D ELSE (2D - _j) * 2D / 3D END AS _z", "pmod(_ft * _nr + _u - _v, 8D) AS _t")
        df = df.selectExpr("*", f"acos(greatest(-1D, least(1D, _z))) AS theta_{k}", f"if(_nr < 1e-15D, 0D, pi() / 4D * _t / _nr) AS phi_{k}")
        df = _drop(df, "_u", "_v", "_j", "_nr", "_z", "_t")
    return _drop(df, "_face", "_x", "_y", "_fr", "_ft")


def normal_lon(lon: Column, convention: str) -> Column:
    """Longitude in [0, 360) or [-180, 180)."""
    return F.pmod(lon, F.lit(360.0)) if convention == "0_360" else F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def with_corner_degrees(df: DataFrame, convention: str = "0_360") -> DataFrame:
    """Adds lon_0..3 and lat_0..3 from theta and phi."""
    new = {}
    for k in range(4):
        new[f"lon_{k}"] = normal_lon(F.degrees(f"phi_{k}"), convention)
        new[f"lat_{k}"] = 90.0 - F.degrees(f"theta_{k}")
    return df.withColumns(new)


def unwrapped(df: DataFrame) -> DataFrame:
    """Corner longitudes of cells over the seam moved to one side, so that the polygon does not span the globe."""
    lons = [f"lon_{k}" for k in range(4)]
    wide = F.greatest(*lons) - F.least(*lons) > 180.0
    return df.withColumn("_wide", wide).withColumns({c: F.when(F.col("_wide") & (F.col(c) < F.greatest(*lons) - 180.0), F.col(c) + 360.0).otherwise(F.col(c)) for c in lons}).drop("_wide")


def sphere_angles(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Adds theta and phi of unit vectors."""
    return df.withColumns({"theta": F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col(z)))), "phi": F.pmod(F.atan2(y, x), F.lit(6.283185307179586))})


def parent(cell: Column | str, levels: int) -> Column:
    """The nested cell `levels` resolutions coarser."""
    return F.shiftright(F.col(cell) if isinstance(cell, str) else cell, 2 * levels)


# --- conventions of longitude ----------------------------------------------------------------------------------------

#: The names by which the two conventions go.
CONVENTIONS = {"0_360": "0_360", "minus_plus180": "-180_180", "-180_180": "-180_180", "minus_plus_180": "-180_180"}
RANGES = {"0_360": (0.0, 360.0), "-180_180": (-180.0, 180.0)}


def check_convention(name: str) -> str:
    if name not in CONVENTIONS:
        raise ValueError(f"longitude convention must be one of {sorted(CONVENTIONS)}, not {name!r}")
    return CONVENTIONS[name]
