"""Schemas of the tables, and the configuration with its defaults."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The court in metres, and its calibration landmarks and line segments.
COURT_WIDTH, COURT_LENGTH, NET_Y, CENTRE_X = 10.0, 20.0, 10.0, 5.0
SERVICE_NEAR, SERVICE_FAR = 3.05, 16.95
GRAVITY = 9.81

BALL_LABEL = "frame int, visible int, u double, v double"
BALL_TRACK = "x double, y double, vx double, vy double, speed_px_s double, std_x double, std_y double, status string, measured boolean, gated boolean, coast int, meas_u double, meas_v double"
BALL_EVENT = "frame int, type string, u double, v double, x_m double, y_m double, in_court boolean"
BALL_3D = "x double, y double, z double, std array<double>, reproj_px double, speed_kmh double"
FRAME_LOG = f"frame int, found boolean, u double, v double, confidence double, reason string, track struct<{BALL_TRACK.replace(' double', ': double').replace(' string', ': string').replace(' boolean', ': boolean').replace(' int', ': int')}>, event struct<{BALL_EVENT.replace(' double', ': double').replace(' string', ': string').replace(' boolean', ': boolean').replace(' int', ': int')}>, ball3d struct<x: double, y: double, z: double, std: array<double>, reproj_px: double, speed_kmh: double>"
DETECTION = "clip string, cam string, frame int, det_idx int, x1 double, y1 double, x2 double, y2 double, conf double, keypoints array<struct<x: double, y: double, c: double>>, color_hist array<double>, track_id int"
CANDIDATE = "clip string, frame int, cand_idx int, u double, v double, confidence double"


@dataclass(frozen=True)
class TrackerConfig:
    """Constant-velocity filter of the ball in pixels."""

    q: float = 50_000.0
    r: float = 25.0
    conf_ref: float = 0.7
    conf_floor: float = 0.05
    max_coast: int = 15
    gate: float = 0.0  # 0: off
    gate_after: int = 3
    associate_px: float = 600.0
    dt: float = 1 / 20
    p_velocity: float = 1e6


@dataclass(frozen=True)
class EventConfig:
    min_vy: float = 500.0
    min_vx: float = 500.0
    wall_m: float = 0.6
    hit_angle_deg: float = 70.0
    hit_speed: float = 1500.0
    refractory: int = 3
    in_out_m: float = 0.1
    near_court_m: float = 1.5


@dataclass(frozen=True)
class SuppressConfig:
    link_px: float = 90.0
    drop_after: int = 10
    min_frames: int = 40
    still_px: float = 10.0
    release_px: float = 60.0
    radius_px: float = 14.0
    max_zones: int = 16


@dataclass(frozen=True)
class EkfConfig:
    meas_px: float = 15.0
    q_pos: float = 0.02
    q_vel: float = 6.0
    q_pos_z: float = 0.01
    q_vel_z: float = 0.5
    restitution: float = 0.7
    bounce_z: float = 0.7
    z_max: float = 8.0
    p0: tuple[float, ...] = (1.0, 1.0, 1.0, 36.0, 36.0, 36.0)


@dataclass(frozen=True)
class IdentityConfig:
    w_pos: float = 0.6
    w_color: float = 0.4
    threshold: float = 0.5
    position_ttl: int = 90
    ema: float = 0.0
    diagonal_m: float = 22.360679774997898
    profiles: tuple[int, ...] = (1, 2, 3, 4)


@dataclass(frozen=True)
class MiningConfig:
    low_conf: float = 0.6
    max_gap: int = 8
    reach: int = 3
    min_support: int = 1
    static_window: int = 5
    static_radius: float = 25.0
    static_run: int = 5


@dataclass(frozen=True)
class Config:
    tracker: TrackerConfig = field(default_factory=TrackerConfig)
    events: EventConfig = field(default_factory=EventConfig)
    suppress: SuppressConfig = field(default_factory=SuppressConfig)
    ekf: EkfConfig = field(default_factory=EkfConfig)
    identity: IdentityConfig = field(default_factory=IdentityConfig)
    mining: MiningConfig = field(default_factory=MiningConfig)
