"""Column functions of axes, rotations and fields of view. Angles are degrees unless stated otherwise."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def rotation_matrix(yaw: Column, pitch: Column, roll: Column) -> Column:
    """The nine entries, by rows, of turns about the fixed axes z, then y, then x: Rx(roll) Ry(pitch) Rz(yaw)."""
    cz, sz, cy, sy, cx, sx = (f(F.radians(a)) for a in (yaw, pitch, roll) for f in (F.cos, F.sin))
    return F.array(
        cy * cz, -cy * sz, sy,
        cx * sz + sx * sy * cz, cx * cz - sx * sy * sz, -sx * cy,
        sx * sz - cx * sy * cz, sx * cz + cx * sy * sz, cx * cy,
    )


def vertical_fov(aspect: Column, horizontal: Column) -> Column:
    """Vertical field of view of a flat image with the given width to height."""
    return 2 * F.degrees(F.atan(F.tan(F.radians(horizontal / 2)) / aspect))


def aspect_of(horizontal: Column, vertical: Column) -> Column:
    """Width to height of a flat image with the given fields of view."""
    return F.tan(F.radians(horizontal / 2)) / F.tan(F.radians(vertical / 2))


def flat_size(width: Column, height: Column, horizontal: Column, vertical: Column, radius_factor: float) -> Column:
    """(width, height) of the flat image whose centre has the scale of a fisheye image's centre."""
    radius = F.least(width / 2, height / 2) * radius_factor
    return F.struct(F.rint(2 * radius * horizontal / 360).cast("int").alias("width"), F.rint(2 * radius * vertical / 360).cast("int").alias("height"))


def remap(vector: Column, axes: Sequence[int], signs: Sequence[int]) -> Column:
    """A vector in other axes: component i is ``signs[i]`` times the old component ``axes[i]``."""
    if sorted(axes) != [0, 1, 2] or any(s not in (-1, 1) for s in signs) or len(signs) != 3:
        raise ValueError(f"no axes: {axes}, {signs}")
    return F.array(*[F.get(vector, F.lit(a)) * s for a, s in zip(axes, signs, strict=True)])
