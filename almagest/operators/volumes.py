"""Sizes of data products, as columns over tables of parameters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes of a visibility per channel (four polarisations of value, weight and flag) and per row, bytes of a TB, and the folded rate of a pulsar search in TB/s.
PER_CHANNEL, PER_ROW, TB = 52, 141, 1e12
PULSAR_SEARCH_TB_S = 0.0839 / 1024


def channels(bandwidth_hz: Column, width_hz: Column) -> Column:
    """Number of channels; null where a width is not positive."""
    return F.when((bandwidth_hz > 0) & (width_hz > 0), F.ceil(F.round(bandwidth_hz / width_hz, 3)))


def visibilities_tb(n_station: Column, duration_s: Column, t_int_s: Column, n_chan: Column) -> Column:
    """Baselines with autocorrelations, times dumps, times the row's bytes."""
    return n_station * (n_station + 1) / 2 * F.ceil(duration_s / t_int_s) * (PER_CHANNEL * n_chan + PER_ROW) / TB


def n_pix(fov_deg: Column, resolution_arcsec: Column, oversampling: Column) -> Column:
    return F.floor(fov_deg * 3600 / resolution_arcsec + 1e-9) * oversampling


def cube_tb(pixels: Column, n_chan: Column, n_stokes: Column, n_bit: Column, n_beam: Column) -> Column:
    return pixels * pixels * n_chan * n_stokes * n_bit / 8 * n_beam / TB


def autocorrelations_tb(n_dish: Column, n_pol: Column, n_chan: Column, duration_s: Column, t_int_s: Column, n_bit: Column) -> Column:
    return n_dish * n_pol * n_chan * F.ceil(duration_s / t_int_s) * n_bit / 8 / TB


def timing_tb(n_chan: Column, n_phase: Column, n_stokes: Column, n_bit: Column, n_sub: Column, hours: Column) -> Column:
    return n_chan * n_phase * n_stokes * n_bit / 8 * n_sub * hours / TB


def pulsar_search_tb(duration_s: Column) -> Column:
    return duration_s * PULSAR_SEARCH_TB_S
