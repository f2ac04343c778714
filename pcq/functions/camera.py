"""Cameras: scalar algebra on the driver, and column builders for both projections."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: An isometric fit leaves this part of the viewport filled; an orbit camera's limits and lens.
MARGIN, FOV, NEAR, FAR = 0.85, 60.0, 0.1, 100000.0
PHI_LIMIT, RADIUS_LIMITS = 0.01, (0.1, 1e5)
#: Fixed value: what a pixel of a drag moves an orbit camera by, times its distance.
PAN_SCALE = 0.0005
#: Named views as (rotation, tilt x, tilt y) in degrees, and headings.
PRESETS = {"top": (0.0, 90.0, 0.0), "front": (0.0, 0.0, 0.0), "right": (90.0, 0.0, 0.0), "back": (180.0, 0.0, 0.0)}
HEADINGS = {"N": 0.0, "E": 90.0, "S": 180.0, "W": 270.0}


@dataclass(frozen=True)
class View:
    """An isometric view. Angles: rot in radians, tilts in degrees."""

    zoom: float = 1.0
    pan_x: float = 0.0
    pan_y: float = 0.0
    rot: float = 0.0
    tilt_x: float = 0.0
    tilt_y: float = 0.0
    center: tuple[float, float, float] = (0.0, 0.0, 0.0)
    width: int = 1280
    height: int = 720

    def rows(self) -> tuple[tuple[float, float, float], ...]:
        """The rotated axes: three rows that map a centred point to (rx, ry, rz)."""
        cx, sx = math.cos(math.radians(self.tilt_x)), math.sin(math.radians(self.tilt_x))
        cy, sy = math.cos(math.radians(self.tilt_y)), math.sin(math.radians(self.tilt_y))
        c, s = math.cos(self.rot), math.sin(self.rot)
        tx = (cy, sy * sx, sy * cx)
        ty = (0.0, cx, -sx)
        tz = (-sy, cy * sx, cy * cx)
        rx = tuple(a * c - b * s for a, b in zip(tx, ty, strict=True))
        ry = tuple(a * s + b * c for a, b in zip(tx, ty, strict=True))
        return rx, ry, tz

    def screen(self) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
        """(a, b, c, constant) of screen x, screen y and the depth key, as linear forms of a point."""
        rx, ry, rz = self.rows()
        forms = []
        for k, (row, shift, scale) in enumerate(
            (
                (tuple(p - q for p, q in zip(rx, ry, strict=True)), self.pan_x, self.zoom),
                (tuple((p + q) * 0.5 - r for p, q, r in zip(rx, ry, rz, strict=True)), self.pan_y, self.zoom),
                (tuple(p + q - r for p, q, r in zip(rx, ry, rz, strict=True)), 0.0, 1.0),
            )
        ):
            coef = tuple(v * scale for v in row)
            forms.append((*coef, shift - sum(v * m for v, m in zip(coef, self.center, strict=True))))
        return tuple(forms)


def linear(form: tuple[float, ...], x: Column, y: Column, z: Column) -> Column:
    a, b, c, d = form
    return x * F.lit(a) + y * F.lit(b) + z * F.lit(c) + F.lit(d)


def low_high(form: tuple[float, ...], lo: tuple[Column, ...], hi: tuple[Column, ...]) -> tuple[Column, Column]:
    """Least and greatest value of a linear form over a box, without its corners."""
    low = high = F.lit(form[3])
    for a, p, q in zip(form[:3], lo, hi, strict=True):
        low, high = low + (p if a >= 0 else q) * F.lit(a), high + (q if a >= 0 else p) * F.lit(a)
    return low, high


def project_iso(df: DataFrame, view: View) -> DataFrame:
    """Adds sx, sy (pixels) and depth_key."""
    fx, fy, fd = view.screen()
    p = tuple(F.col(c).cast("double") for c in ("x", "y", "z"))
    return df.withColumns({"sx": linear(fx, *p), "sy": linear(fy, *p), "depth_key": linear(fd, *p)})


def depth_range(lo: tuple, hi: tuple, angle: float) -> tuple[float, float]:
    """Of the eight corners of a box about its centre; a flat range is widened by 1."""
    form = View(rot=angle, center=tuple((a + b) / 2 for a, b in zip(lo, hi, strict=True))).screen()[2]
    least = form[3] + sum(min(a * p, a * q) for a, p, q in zip(form, lo, hi, strict=False))
    most = form[3] + sum(max(a * p, a * q) for a, p, q in zip(form, lo, hi, strict=False))
    return least, most + 1 if most == least else most


def fit_view(view: View, lo: tuple, hi: tuple) -> View:
    """Zoom and pan so that the box fills the viewport but for a margin."""
    centred = replace(view, zoom=1.0, pan_x=0.0, pan_y=0.0, center=tuple((a + b) / 2 for a, b in zip(lo, hi, strict=True)))
    spans = []
    for form in centred.screen()[:2]:
        low = form[3] + sum(min(a * p, a * q) for a, p, q in zip(form, lo, hi, strict=False))
        high = form[3] + sum(max(a * p, a * q) for a, p, q in zip(form, lo, hi, strict=False))
        spans.append((low, high))
    zoom = min(side * MARGIN / ((high - low) or 1) for side, (low, high) in zip((view.width, view.height), spans, strict=True))
    mid = [(low + high) / 2 * zoom for low, high in spans]
    return replace(centred, zoom=zoom, pan_x=view.width / 2 - mid[0], pan_y=view.height / 2 - mid[1])


def face_center(lo: tuple, hi: tuple, angle: float, tilt_x: float = 0.0) -> tuple[float, float, float]:
    """Between the centres of the two faces that the angle lies between. The third coordinate mixes in the y extent, which
    views of this kind are made for; the plain centre is the mean of lo and hi."""
    mid = [(a + b) / 2 for a, b in zip(lo, hi, strict=True)]
    faces = ((mid[0], hi[1]), (hi[0], mid[1]), (mid[0], lo[1]), (lo[0], mid[1]))
    turn = angle % (2 * math.pi) / (math.pi / 2)
    k = int(turn)
    (x0, z0), (x1, z1) = faces[k % 4], faces[(k + 1) % 4]
    y = hi[1] if tilt_x > 45 else lo[1] if tilt_x < -45 else mid[1]
    return x0 + (x1 - x0) * (turn - k), y, z0 + (z1 - z0) * (turn - k)


#: Tilts about x and y, in degrees, of the preset views.
PRESETS = {"top": (0.0, 0.0), "front": (90.0, 0.0), "right": (90.0, -90.0), "back": (-90.0, 0.0)}
TILT_LIMIT = 89.0


def turned(angle: Column, by: Column | float) -> Column:
    """An angle turned by another one, from 0 up to a full circle."""
    return F.pmod(angle + by, F.lit(2 * math.pi))


def turned_step(angle: Column, steps: Column | int, bins: int) -> Column:
    """Turned left by so many steps of 4 or 8 headings (right, if negative)."""
    return turned(angle, steps * F.lit(2 * math.pi / bins))


def heading(index: Column, bins: int) -> Column:
    """The angle of a heading by its number, counted right from an eighth of a circle."""
    return F.pmod(F.lit(math.pi / 4) - index * F.lit(2 * math.pi / bins), F.lit(2 * math.pi))


def heading_index(angle: Column, bins: int) -> Column:
    """The number of the nearest heading."""
    step = 2 * math.pi / bins
    return F.pmod(F.floor((F.lit(math.pi / 4) - angle) / step + 0.5), F.lit(bins)).cast("int")


def tilted(tilt: Column, by: Column) -> Column:
    return F.greatest(F.lit(-TILT_LIMIT), F.least(F.lit(TILT_LIMIT), tilt + by))


def preset(view: View, name: str) -> View:
    """One of the preset views, at the first heading; fit_view then brings the cloud into sight."""
    tilt_x, tilt_y = PRESETS[name]
    return replace(view, tilt_x=tilt_x, tilt_y=tilt_y, rot=math.pi / 4)


def view_direction(angle: Column) -> tuple[Column, Column, Column]:
    """The unit vector along which an isometric view of this heading looks."""
    c, s = F.cos(angle), F.sin(angle)
    x, y = -(c + s), -(c - s)
    n = F.sqrt(x * x + y * y + 1)
    return x / n, y / n, 1 / n


def zoom_at(view: View, px: float, py: float, factor: float) -> View:
    """Zoom so that the pixel stays where it is."""
    return replace(view, zoom=view.zoom * factor, pan_x=px - (px - view.pan_x) * factor, pan_y=py - (py - view.pan_y) * factor)


def view_index(angle: Column, bins: int) -> Column:
    """The nearest of 4 or 8 headings."""
    return F.pmod(F.floor(angle / (2 * math.pi / bins) + 0.5), F.lit(bins)).cast("int")


def moved(theta: Column, target: tuple[Column, ...], ahead: Column, right: Column, up: Column) -> tuple[Column, ...]:
    """Orbit.move for rows of cameras."""
    c, s, (x, y, z) = F.cos(theta), F.sin(theta), target
    return x + right * c - ahead * s, y + up, z - right * s - ahead * c


def panned(theta: Column, radius: Column, target: tuple[Column, ...], dx: Column, dy: Column) -> tuple[Column, ...]:
    """Orbit.pan for rows of cameras."""
    return moved(theta, target, F.lit(0.0), dx * radius * PAN_SCALE, dy * radius * PAN_SCALE)


def orbited(phi: Column, by: Column) -> Column:
    """The angle from the y axis, within its limits."""
    return F.least(F.lit(math.pi - PHI_LIMIT), F.greatest(F.lit(PHI_LIMIT), phi + by))


def dollied(radius: Column, factor: Column) -> Column:
    return F.least(F.lit(RADIUS_LIMITS[1]), F.greatest(F.lit(RADIUS_LIMITS[0]), radius * factor))


@dataclass(frozen=True)
class Orbit:
    """A perspective camera about a target. theta: azimuth, phi: from the y axis, both in radians."""

    radius: float = 100.0
    phi: float = math.pi / 3
    theta: float = math.pi / 4
    target: tuple[float, float, float] = (0.0, 0.0, 0.0)
    width: int = 1280
    height: int = 720
    fov: float = FOV

    def orbit(self, d_theta: float, d_phi: float) -> Orbit:
        return replace(self, theta=self.theta + d_theta, phi=min(math.pi - PHI_LIMIT, max(PHI_LIMIT, self.phi + d_phi)))

    def dolly(self, factor: float) -> Orbit:
        return replace(self, radius=min(RADIUS_LIMITS[1], max(RADIUS_LIMITS[0], self.radius * factor)))

    def move(self, ahead: float = 0.0, right: float = 0.0, up: float = 0.0) -> Orbit:
        """The target, and with it the eye, moved along the ground, as the camera faces it, and upwards."""
        c, s = math.cos(self.theta), math.sin(self.theta)
        x, y, z = self.target
        return replace(self, target=(x + right * c - ahead * s, y + up, z - right * s - ahead * c))

    def pan(self, dx: float, dy: float) -> Orbit:
        """The target moved by a drag on the screen, the further the farther the eye is."""
        return self.move(right=dx * self.radius * PAN_SCALE, up=dy * self.radius * PAN_SCALE)

    def fit(self, lo: tuple, hi: tuple) -> Orbit:
        return replace(self, radius=1.5 * max(b - a for a, b in zip(lo, hi, strict=True)), theta=math.pi / 4, phi=math.pi / 3, target=tuple((a + b) / 2 for a, b in zip(lo, hi, strict=True)))

    def position(self) -> tuple[float, float, float]:
        s = math.sin(self.phi) * self.radius
        return (self.target[0] + s * math.sin(self.theta), self.target[1] + self.radius * math.cos(self.phi), self.target[2] + s * math.cos(self.theta))

    def view_matrix(self) -> list[list[float]]:
        """Rows of the 4 x 4 look-at matrix."""
        eye = self.position()
        back = [a - b for a, b in zip(eye, self.target, strict=True)]
        n = math.sqrt(sum(v * v for v in back))
        back = [v / n for v in back]
        right = [back[2], 0.0, -back[0]]
        n = math.hypot(*right)
        right = [v / n for v in right]
        up = [back[1] * right[2] - back[2] * right[1], back[2] * right[0] - back[0] * right[2], back[0] * right[1] - back[1] * right[0]]
        return [[*row, -sum(a * b for a, b in zip(row, eye, strict=True))] for row in (right, up, back)] + [[0.0, 0.0, 0.0, 1.0]]

    def projection_matrix(self) -> list[list[float]]:
        f = 1 / math.tan(math.radians(self.fov) / 2)
        return [[f * self.height / self.width, 0, 0, 0], [0, f, 0, 0], [0, 0, (FAR + NEAR) / (NEAR - FAR), 2 * FAR * NEAR / (NEAR - FAR)], [0, 0, -1.0, 0]]

    def clip(self) -> list[list[float]]:
        p, v = self.projection_matrix(), self.view_matrix()
        return [[sum(p[i][k] * v[k][j] for k in range(4)) for j in range(4)] for i in range(4)]

    def planes(self) -> list[tuple[float, float, float, float]]:
        """Six planes a, b, c, d; a point is inside where all of ax + by + cz + d are at least 0."""
        m = self.clip()
        return [tuple(m[3][j] + sign * m[i][j] for j in range(4)) for i in range(3) for sign in (1, -1)]


def project_persp(df: DataFrame, cam: Orbit) -> DataFrame:
    """Adds clip_x, clip_y, clip_w, view_dist and depth_norm."""
    m, v = cam.clip(), cam.view_matrix()
    p = tuple(F.col(c).cast("double") for c in ("x", "y", "z"))
    dist = -linear(tuple(v[2]), *p)
    norm = F.least(F.greatest((dist - 0.1) / 9999.9, F.lit(0.0)), F.lit(1.0))
    return df.withColumns({"clip_x": linear(tuple(m[0]), *p), "clip_y": linear(tuple(m[1]), *p), "clip_w": linear(tuple(m[3]), *p), "view_dist": dist, "depth_norm": norm})


def in_frustum(cam: Orbit, lo: tuple[Column, ...], hi: tuple[Column, ...]) -> Column:
    """A box is culled if its corner furthest along some plane's normal is outside that plane."""
    ok = F.lit(True)
    for plane in cam.planes():
        ok = ok & (low_high(plane, lo, hi)[1] >= 0)
    return ok
