"""Operations and derivations by name, for recipes."""

from __future__ import annotations

from ..plans.recipes import derivation, finite, one_of, operation, positive, truth, whole, whole_from
from . import edit, kinematics, ordered, outliers, resample

operation("swap-lat-lon", 1, ranged=True)(edit.swap_lat_lon)
operation("drop-invalid", 1)(edit.drop_invalid)
operation("shift-time", 1, ranged=True, seconds=finite)(edit.shift_time)
operation("offset-elevation", 1, ranged=True, meters=finite)(edit.offset_elevation)
operation("clip-time-range", 1, start_ms=finite, end_ms=finite, untimed=one_of("keep", "drop"))(edit.clip_time_range)
operation("round-precision", 1, ranged=True, coord=whole_from(0), ele=whole_from(0))(edit.round_precision)
operation("sort-by-time", 1)(ordered.sort_by_time)
operation("smooth", 1, ranged=True, window=whole_from(2), coords=truth, elevation=truth)(ordered.smooth)
operation("median-filter", 1, ranged=True, window=whole_from(3))(ordered.median_filter)
operation("hampel", 1, ranged=True, sigma=positive, window=whole)(ordered.hampel)
operation("ema", 1, ranged=True, alpha=positive)(ordered.ema)
operation("decimate", 1, factor=whole_from(1))(ordered.decimate)
operation("dedupe", 1, tolerance_m=finite)(ordered.dedupe)
operation("simplify", 1, epsilon_m=finite)(ordered.simplify)
operation("dejitter", 1, policy=one_of("nudge", "drop", "average"), epsilon_ms=positive)(ordered.dejitter)
operation("kinematics", 1)(kinematics.kinematics)
operation("resample-fixed-rate", 1, rate_hz=positive, mode=one_of("linear", "step"), max_gap_ms=positive, duplicates=one_of("refuse", "first"))(resample.resample_fixed_rate)
operation("resample-by-distance", 1, interval_m=positive)(resample.resample_by_distance)
operation("notional-fill", 1, gap_ms=positive, sample_ms=positive)(resample.notional_fill)
operation("fill-gaps", 1, gap_ms=positive, sample_ms=positive, context=whole_from(2), profile=one_of(*outliers.PROFILES))(outliers.fill_gaps)
operation("drop-outliers", 2, profile=one_of(*outliers.PROFILES), reconstruct=truth, context=whole_from(2), window=whole_from(1), threshold=positive, position_floor=positive, elevation_floor=positive, speed_floor=positive)(outliers.drop_outliers)

derivation("standard-kinematics", 1, ("lat", "lon", "time_ms"), kinematics.MOTION)(kinematics.kinematics)
derivation("point-speeds", 1, ("lat", "lon", "time_ms"), ("speed_mps",))(kinematics.point_speeds)
derivation("legs", 1, ("lat", "lon", "ele", "time_ms"))(kinematics.legs)
