"""Points and poses as array columns: filters, rigid transforms, distances, projection.

A point is an array of numbers x, y, z, Doppler, signal and, where there is one, a
target id; a cloud is an array of points; a pose is an array of joints x, y, z.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Target ids of noise, skeleton limbs, joint and channel orders, joints without the uncertain head.
NOISE_TARGETS = (253.0, 254.0, 255.0)
LIMBS = ((0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 6), (0, 7), (7, 8), (8, 9), (9, 10), (7, 11), (11, 12), (12, 13), (7, 14), (14, 15), (15, 16))
JOINTS = 17
BODY15 = tuple(i for i in range(JOINTS) if i not in (9, 10))
JOINTS_32_TO_17 = (0, 18, 19, 20, 22, 23, 24, 2, 3, 27, 26, 12, 13, 14, 5, 6, 7)
POINT_ORDER = (1, 0, 2, 4, 3)
POSE_ORDER = (0, 2, 1)
#: Mounting of the sensor.
SENSOR_HEIGHT_M, SENSOR_PITCH_DOWN_DEG = 1.76, 30.0
DOPPLER_LIMIT = 3.0
SIGNAL_LIMIT = math.log2(100)
#: The colour of points without a scale; the ramp's red (slope, offset), green (top, slope, middle) and blue (slope, offset).
CONSTANT_COLOUR = (1.0, 0.2, 0.1, 0.85)
RAMP = ((2.0, -0.2), (1.0, -2.0, 0.5), (-2.0, 1.2))
RAMP_ALPHA = 0.9


def is_finite(x: Column) -> Column:
    return F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False))


def at(a: Column, i: int) -> Column:
    """Element i from 0; null beyond the end."""
    return F.get(a, F.lit(i))


def points_or_empty(cloud: Column) -> Column:
    return F.coalesce(cloud, F.array().cast("array<array<double>>"))


def without_noise(cloud: Column) -> Column:
    """Points with a finite target id that is none of noise; points without ids stay."""
    ok = lambda p: F.when(F.size(p) < 6, True).otherwise(is_finite(at(p, 5)) & ~F.coalesce(at(p, 5).isin(*NOISE_TARGETS), F.lit(False)))
    return F.filter(points_or_empty(cloud), ok)


def valid_points(cloud: Column, noise_filter: bool = False) -> Column:
    """Points with finite x, y, z."""
    base = without_noise(cloud) if noise_filter else points_or_empty(cloud)
    return F.filter(base, lambda p: is_finite(at(p, 0)) & is_finite(at(p, 1)) & is_finite(at(p, 2)))


def _finite5(p: Column) -> Column:
    return F.forall(F.slice(p, 1, 5), is_finite) & (F.size(p) >= 5)


def radar_points(cloud: Column, noise_filter: bool) -> Column:
    """The first five columns of points where they are finite."""
    base = without_noise(cloud) if noise_filter else points_or_empty(cloud)
    return F.transform(F.filter(base, _finite5), lambda p: F.slice(p, 1, 5))


def model_points(cloud: Column) -> Column:
    """Points that are no padding for the model: five finite columns, some of x, y, z off zero."""
    return F.filter(points_or_empty(cloud), lambda p: _finite5(p) & F.exists(F.slice(p, 1, 3), lambda x: F.abs(x) > 1e-8))


def diagnostic_points(cloud: Column) -> Column:
    """Points that are no padding for diagnostics: five finite columns, any of them off zero."""
    return F.filter(points_or_empty(cloud), lambda p: _finite5(p) & F.exists(F.slice(p, 1, 5), lambda x: F.abs(x) > 1e-8))


def rigid(p: Column, rotation: Sequence[Sequence[float]], translation: Sequence[float] = (0.0, 0.0, 0.0)) -> Column:
    """R p + t of the first three numbers; the others stay."""
    moved = [sum((at(p, j) * float(rotation[i][j]) for j in range(3)), F.lit(0.0)) + float(translation[i]) for i in range(3)]
    return F.concat(F.array(*moved), F.slice(p, F.lit(4), F.greatest(F.size(p) - 3, F.lit(0))))


def each(cloud: Column, fn) -> Column:
    return F.transform(cloud, fn)


def transposed(m: Sequence[Sequence[float]]) -> list[list[float]]:
    return [list(r) for r in zip(*m, strict=True)]


def sensor_rotation(pitch_down_deg: float = SENSOR_PITCH_DOWN_DEG) -> list[list[float]]:
    """Rotation about x that takes a sensor tilted down by pitch to the level world."""
    c, s = math.cos(math.radians(pitch_down_deg)), math.sin(math.radians(pitch_down_deg))
    return [[1.0, 0.0, 0.0], [0.0, c, s], [0.0, -s, c]]


def to_world(cloud: Column, height: float = SENSOR_HEIGHT_M, pitch_down_deg: float = SENSOR_PITCH_DOWN_DEG) -> Column:
    """Sensor points in the world frame; other columns stay."""
    return each(cloud, lambda p: rigid(p, sensor_rotation(pitch_down_deg), (0.0, 0.0, height)))


def euler_rotation(roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Rz Ry Rx, angles in radians."""
    (cr, sr), (cp, sp), (cy, sy) = ((math.cos(a), math.sin(a)) for a in (roll, pitch, yaw))
    return [
        [cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr],
        [sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr],
        [-sp, cp * sr, cp * cr],
    ]


def euler_angles(rotation: Sequence[Sequence[float]]) -> tuple[float, float, float]:
    """Roll, pitch, yaw in degrees of a rotation that acts on row vectors."""
    r = transposed(rotation)
    flat = math.hypot(r[0][0], r[1][0])
    if flat > 1e-6:
        angles = math.atan2(r[2][1], r[2][2]), math.atan2(-r[2][0], flat), math.atan2(r[1][0], r[0][0])
    else:
        angles = math.atan2(-r[1][2], r[1][1]), math.atan2(-r[2][0], flat), 0.0
    return tuple(math.degrees(a) for a in angles)


def pose_to_sensor(pose: Column, scale: float = 1e-3) -> Column:
    """Camera joints x, y, z in mm to sensor axes x, z, -y in m."""
    return each(pose, lambda j: F.array(at(j, 0) * scale, at(j, 2) * scale, at(j, 1) * -scale))


def pose_to_world(pose: Column, scale: float = 1e-3) -> Column:
    return to_world(pose_to_sensor(pose, scale))


def pose_17(people: Column, person: int = 0, euler_deg: Sequence[float] = (0.0, 0.0, 0.0), translation: Sequence[float] = (0.0, 0.0, 0.0)) -> Column:
    """17 joints in sensor axes of one person of 32 joints; null if the person or joints are missing."""
    joints = at(people, person)
    rotation = euler_rotation(*map(math.radians, euler_deg))
    # the joints that stay are moved, once each
    picked = F.array(*[at(joints, i) for i in JOINTS_32_TO_17])
    moved = each(pose_to_sensor(picked), lambda j: rigid(j, rotation, translation))
    return F.when((F.size(joints) >= 32) & (F.size(at(joints, 0)) >= 3), moved)


def pose_17_raw(people: Column, person: int = 0) -> Column:
    """17 joints of one person in camera axes, metres; null if missing."""
    joints = at(people, person)
    picked = F.array(*[F.transform(F.slice(at(joints, i), 1, 3), lambda x: x * 1e-3) for i in JOINTS_32_TO_17])
    return F.when((F.size(joints) >= 32) & (F.size(at(joints, 0)) >= 3), picked)


def camera_axes_to_sensor(cloud: Column) -> Column:
    """[x, y, z] to [x, z, -y]."""
    return each(cloud, lambda p: F.array(at(p, 0), at(p, 2), -at(p, 1)))


def reordered(cloud: Column, order: Sequence[int]) -> Column:
    return each(cloud, lambda p: F.array(*[at(p, i) for i in order]))


def axis_transforms() -> list[tuple[str, tuple[int, ...], tuple[int, ...], int]]:
    """The 48 signed permutations of three axes: name, permutation, signs, determinant."""
    out = []
    for perm in itertools.permutations(range(3)):
        parity = 1 if sum(a > b for a, b in itertools.combinations(perm, 2)) % 2 == 0 else -1
        for signs in itertools.product((1, -1), repeat=3):
            name = ",".join(("-" if s < 0 else "") + "xyz"[i] for i, s in zip(perm, signs, strict=True))
            out.append((name, perm, signs, parity * math.prod(signs)))
    return out


def axis_transformed(p: Column, perm: Column | Sequence[int], signs: Column | Sequence[int]) -> Column:
    """A point's axes permuted, then signed; perm and signs may be columns."""
    if isinstance(perm, Column):
        return F.transform(perm, lambda axis, i: F.get(p, axis) * F.get(signs, i))
    return F.array(*[at(p, i) * float(s) for i, s in zip(perm, signs, strict=True)])


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(F.slice(a, 1, 3), F.slice(b, 1, 3), lambda x, y: x.cast("double") - y.cast("double"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    return norm(minus(a, b))


def segment_distance(p: Column, a: Column, b: Column) -> Column:
    """From a point to the nearest point of a segment; of a segment without length, to its start."""
    ab, ap = minus(b, a), minus(p, a)
    length = dot(ab, ab)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(ap, ab) / length))
    near = norm(F.zip_with(ap, ab, lambda x, y: x - t * y))
    return F.when(length < 1e-12, norm(ap)).otherwise(near)


def skeleton_distance(p: Column, pose: Column) -> Column:
    """From a point to the nearest of the skeleton's limbs."""
    return F.least(*[segment_distance(p, at(pose, a), at(pose, b)) for a, b in LIMBS])


def pose_root(pose: Column) -> Column:
    return at(pose, 0)


def root_relative(pose: Column) -> Column:
    return each(pose, lambda j: minus(j, at(pose, 0)))


def normalised_shape(pose: Column) -> Column:
    """Root-relative pose over its pelvis-to-neck length; where that is 0.2 or less or not
    finite, over the median limb length; at least 0.001."""

    def scale(p: Column) -> Column:
        neck = distance(at(p, 8), at(p, 0))
        limbs = F.array_sort(F.filter(F.array(*[distance(at(p, a), at(p, b)) for a, b in LIMBS]), is_finite))
        median = bound(limbs, lambda x: (F.get(x, F.floor((F.size(x) - 1) / 2).cast("int")) + F.get(x, F.floor(F.size(x) / 2).cast("int"))) / 2)
        return F.greatest(bound(neck, lambda d: F.when(is_finite(d) & (d > 0.2), d).otherwise(median)), F.lit(1e-3))

    # the pose, its root and its scale are computed once, not for each number
    return bound(pose, lambda p: bound(scale(p), lambda s: bound(at(p, 0), lambda root: each(p, lambda j: F.transform(minus(j, root), lambda x: x / s)))))


def encode_target(pose: Column, mode: str, anchor: Column | None = None) -> Column:
    """absolute; pelvis_relative: joints but the pelvis minus it; cloud_anchor_relative: the pelvis minus the anchor too."""
    if mode == "absolute":
        return pose
    if mode not in ("pelvis_relative", "cloud_anchor_relative"):
        raise ValueError(f"unknown target mode {mode!r}")
    root = at(pose, 0)
    first = minus(root, anchor) if mode == "cloud_anchor_relative" else root
    return F.transform(pose, lambda j, i: F.when(i == 0, first).otherwise(minus(j, root)))


def decode_target(encoded: Column, mode: str, anchor: Column | None = None) -> Column:
    """The inverse of encode_target."""
    if mode == "absolute":
        return encoded
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    root = plus(at(encoded, 0), anchor) if mode == "cloud_anchor_relative" else at(encoded, 0)
    return F.transform(encoded, lambda j, i: F.when(i == 0, root).otherwise(plus(j, root)))


@dataclass(frozen=True)
class Camera:
    """Extrinsics (mm) and intrinsics of a camera with rational radial and tangential distortion."""

    rotation: tuple[tuple[float, ...], ...]
    translation: tuple[float, ...]
    cx: float
    cy: float
    fx: float
    fy: float
    k: tuple[float, ...]
    p1: float
    p2: float
    codx: float = 0.0
    cody: float = 0.0


#: Calibration of the colour camera.
COLOUR_CAMERA = Camera(
    rotation=(
        (0.9999954104423523, 0.0030102587770670652, -0.00032541988184675574),
        (-0.0029597715474665165, 0.9945205450057983, 0.10449939966201782),
        (0.0006382070132531226, -0.10449796169996262, 0.9945248961448669),
    ),
    translation=(-32.0264778137207, -1.8919668197631836, 3.9770002365112305),
    cx=638.5570678710938,
    cy=368.1064147949219,
    fx=611.3757934570312,
    fy=611.5018920898438,
    k=(0.49009519815444946, -2.669199228286743, 1.5499054193496704, 0.36899223923683167, -2.490204334259033, 1.47518789768219),
    p1=0.0005917315138503909,
    p2=-0.0002122735750162974,
)


def bound(value: Column, fn) -> Column:
    """fn(value), with value computed once: an expression that uses it several times does not repeat it."""
    return at(F.transform(F.array(value), fn), 0)


def project(p: Column, camera: Camera = COLOUR_CAMERA) -> Column:
    """Pixel [u, v] of a camera-space point in mm; null beside the camera plane or where not finite."""

    def pixel(xy: Column, r2: Column, d: Column) -> Column:
        x, y = at(xy, 0), at(xy, 1)
        u = x * d + (r2 + 2 * x * x) * camera.p2 + 2 * x * y * camera.p1
        v = y * d + (r2 + 2 * y * y) * camera.p1 + 2 * x * y * camera.p2
        return F.array((u + camera.codx) * camera.fx + camera.cx, (v + camera.cody) * camera.fy + camera.cy)

    def distorted(xy: Column, r2: Column) -> Column:
        poly = lambda a, b, c: 1.0 + r2 * (a + r2 * (b + r2 * c))
        both = F.array(poly(*camera.k[:3]), poly(*camera.k[3:]))
        factor = bound(both, lambda t: F.when(at(t, 1) != 0, at(t, 0) / at(t, 1)).otherwise(at(t, 0)))
        return bound(factor, lambda d: pixel(xy, r2, d))

    def seen(q: Column) -> Column:
        xy = F.array(at(q, 0) / at(q, 2) - camera.codx, at(q, 1) / at(q, 2) - camera.cody)
        flat = bound(xy, lambda w: bound(at(w, 0) * at(w, 0) + at(w, 1) * at(w, 1), lambda r2: distorted(w, r2)))
        return F.when(F.forall(q, is_finite) & (F.abs(at(q, 2)) >= 1e-9), flat)

    return bound(bound(rigid(F.slice(p, 1, 3), camera.rotation, camera.translation), seen), lambda uv: F.when(F.forall(uv, is_finite), uv))


def project_cloud(cloud: Column, noise_filter: bool = False, max_points: int | None = 8000, camera: Camera = COLOUR_CAMERA) -> Column:
    """Cloud as [u, v, z, Doppler, signal, id, ...]; every n-th point where there are more than max_points."""
    kept = valid_points(cloud, noise_filter)
    if max_points:
        every = lambda ps: bound(F.greatest(F.lit(1), F.ceil(F.size(ps) / max_points)), lambda step: F.filter(ps, lambda p, i: i % step == 0))
        kept = bound(kept, every)
    pad = lambda p: F.concat(F.slice(p, F.lit(3), F.size(p) - 2), F.array_repeat(F.lit(float("nan")), F.greatest(6 - F.size(p), F.lit(0))))
    pixel = lambda p: project(F.array(at(p, 0) * 1e3, at(p, 2) * -1e3, at(p, 1) * 1e3), camera)
    placed = F.transform(kept, lambda p: bound(pixel(p), lambda uv: F.when(uv.isNotNull(), F.concat(uv, pad(p)))))
    return F.filter(placed, lambda p: p.isNotNull())


def point_colour(p: Column, mode: str = "constant") -> Column:
    """RGBA of a point by Doppler or signal on a blue, green, red ramp; one colour otherwise, and for points without that column."""
    constant = F.array(*map(F.lit, CONSTANT_COLOUR))
    if mode not in ("doppler", "snr"):
        return constant
    return F.when(F.size(p) > (3 if mode == "doppler" else 4), _ramp(p, mode)).otherwise(constant)


def _ramp(p: Column, mode: str) -> Column:
    if mode == "doppler":
        n = (F.greatest(F.lit(-DOPPLER_LIMIT), F.least(F.lit(DOPPLER_LIMIT), at(p, 3))) + DOPPLER_LIMIT) / (2 * DOPPLER_LIMIT)
    else:
        n = F.when(at(p, 4) > 0, F.log2(at(p, 4)) / SIGNAL_LIMIT).otherwise(0.0)
    n = F.coalesce(F.when(~F.isnan(n), n), F.lit(0.5))
    cut = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    red, green, blue = RAMP
    return bound(n, lambda n: F.array(cut(red[0] * n + red[1]), cut(green[0] + green[1] * F.abs(n - green[2])), cut(blue[0] * n + blue[1]), F.lit(RAMP_ALPHA)))


def finite_limbs(people: Column, connections: Sequence[tuple[int, int]] = LIMBS) -> Column:
    """Person, both joints' numbers and ends of each limb whose ends are finite."""
    ends = lambda person: [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.slice(at(person, a), 1, 3).alias("from"), F.slice(at(person, b), 1, 3).alias("to")) for a, b in connections]
    full = lambda e: (F.size(e) == 3) & F.forall(e, is_finite)
    limbs = F.transform(people, lambda person, i: F.transform(F.filter(F.array(*ends(person)), lambda s: full(s["from"]) & full(s["to"])), lambda s: F.struct(i.alias("person"), s["a"].alias("a"), s["b"].alias("b"), s["from"].alias("from"), s["to"].alias("to"))))
    return F.flatten(limbs)


def canonical_order(cloud: Column) -> Column:
    """Points in order of all their columns."""
    return F.array_sort(cloud)


def normalised_features(p: Column, centre: Column, mode: str = "legacy", doppler_limit: float = 3.0, relative_time: Column | None = None) -> Column:
    """A point's model features without the signal: legacy (8) or cloud_anchor (6) columns."""
    cut = lambda x, lo, hi: F.greatest(F.lit(lo), F.least(F.lit(hi), x))
    xyz = [at(p, i) for i in range(3)]
    centred = [cut((x - at(centre, i)) / 2.0, -2.0, 2.0) for i, x in enumerate(xyz)]
    doppler = cut(at(p, 3), -doppler_limit, doppler_limit) / doppler_limit
    time = cut(relative_time if relative_time is not None else at(p, 5), -1.0, 1.0)
    if mode == "legacy":
        return F.array(*[cut(x / 4.0, -2.0, 2.0) for x in xyz], *centred, doppler, time)
    if mode == "cloud_anchor":
        return F.array(*centred, cut(norm(F.array(*xyz)) / 4.0, 0.0, 2.0), doppler, time)
    raise ValueError(f"unknown spatial mode {mode!r}")
