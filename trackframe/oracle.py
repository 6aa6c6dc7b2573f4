"""Reference SQL (DuckDB dialect) for every registered query.

Each text starts from the fixture F6 over the ``events`` view, written out once
here, and states the operator in plain SQL: windows, ``arg_min``/``arg_max``,
joins.  It is an independent formulation of the same result, used by the
correctness gate at sf0.01 and by the test suite.
"""

from __future__ import annotations

# Fixture F6: one text, valid in Spark SQL and DuckDB.
F6_SQL = """
SELECT q.*,
  CAST(row_number() OVER (PARTITION BY game_id, play_id, nfl_id, is_out ORDER BY event_id) AS BIGINT) AS frame_id,
  CAST(sum(is_out) OVER (PARTITION BY game_id, play_id, nfl_id) AS BIGINT) AS num_frames_output
FROM (
  SELECT event_id, CAST(floor(p / 10) AS BIGINT) AS game_id, p % 10 AS play_id, n AS nfl_id,
    CASE WHEN event_id % 660 >= 440 THEN 1 ELSE 0 END AS is_out,
    (n = 1 OR n >= 14) AS player_to_predict,
    CASE WHEN p % 2 = 0 THEN 'left' ELSE 'right' END AS play_direction,
    CAST(10 + (p * 31) % 100 AS DOUBLE) AS absolute_yardline_number,
    CASE WHEN n = 20 THEN 'bad' ELSE CAST(5 + n % 2 AS STRING) || '-' || CAST(n % 12 AS STRING) END AS player_height,
    CASE WHEN n = 21 THEN NULL ELSE CAST(180 + n * 7 AS DOUBLE) END AS player_weight,
    CASE WHEN n = 0 THEN 'QB' WHEN n <= 3 THEN 'WR' WHEN n <= 5 THEN 'TE' WHEN n <= 10 THEN 'RB'
         WHEN n <= 14 THEN 'CB' WHEN n <= 16 THEN 'FS' ELSE 'ILB' END AS player_position,
    CASE WHEN n < 11 THEN 'Offense' ELSE 'Defense' END AS player_side,
    CASE WHEN n = 0 THEN 'Passer' WHEN n = 1 THEN 'Targeted Receiver'
         WHEN n < 11 THEN 'Other Route Runner' ELSE 'Defensive Coverage' END AS player_role,
    CAST((v * 37 + event_id * 11) % 12000 AS DOUBLE) / 100 AS x,
    CAST((v * 53 + user_id * 29) % 5330 AS DOUBLE) / 100 AS y,
    CAST((v * 17) % 1000 AS DOUBLE) / 100 AS s,
    CAST((v * 13) % 600 AS DOUBLE) / 100 AS a,
    CASE WHEN event_id % 97 = 0 THEN NULL ELSE CAST((v * 91 + event_id * 7) % 36000 AS DOUBLE) / 100 END AS dir,
    CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST((v * 71 + event_id * 3) % 36000 AS DOUBLE) / 100 END AS o,
    CAST((p * 3701) % 12000 AS DOUBLE) / 100 AS ball_land_x,
    CAST((p * 1709) % 5330 AS DOUBLE) / 100 AS ball_land_y
  FROM (SELECT event_id, user_id, user_id % 22 AS n, CAST(floor(event_id / 660) AS BIGINT) AS p,
          CAST(round(value * 100) AS BIGINT) AS v FROM events) e
) q
"""

INPUT_COLS = [
    "game_id", "play_id", "player_to_predict", "nfl_id", "frame_id", "play_direction",
    "absolute_yardline_number", "player_height", "player_weight", "player_position",
    "player_side", "player_role", "x", "y", "s", "a", "dir", "o", "num_frames_output",
    "ball_land_x", "ball_land_y",
]
K3 = ["game_id", "play_id", "nfl_id"]
STATE = ["x", "y", "s", "a", "dir", "o"]

BASE_CTES = [
    ("trk", F6_SQL),
    ("inp", f"SELECT {', '.join(INPUT_COLS)}, CAST(1 + game_id % 18 AS INTEGER) AS week "
            "FROM trk WHERE is_out = 0"),
    ("outp", "SELECT game_id, play_id, nfl_id, frame_id, x, y, CAST(1 + game_id % 18 AS INTEGER) AS week "
             "FROM trk WHERE is_out = 1"),
    ("test_rows", "SELECT game_id, play_id, nfl_id, frame_id, "
                  "concat_ws('_', game_id, play_id, nfl_id, frame_id) AS id FROM outp"),
]


def _last_state_sql(src: str = "inp", drop_week: bool = False) -> str:
    cols = [c for c in INPUT_COLS + ["week"] if c not in K3 and not (drop_week and c == "week")]
    parts = [("max(frame_id) AS frame_id" if c == "frame_id" else f"arg_max({c}, frame_id) AS {c}")
             for c in cols]
    return (f"SELECT game_id, play_id, nfl_id, {', '.join(parts)} FROM {src} "
            "WHERE game_id IS NOT NULL AND play_id IS NOT NULL AND nfl_id IS NOT NULL "
            "GROUP BY game_id, play_id, nfl_id")


def _state_renamed_sql() -> str:
    cols = [c for c in INPUT_COLS if c not in K3]
    sel = []
    for c in cols:
        if c in STATE:
            sel.append(f"{c} AS {c}_input")
        elif c == "frame_id":
            sel.append("frame_id AS last_input_frame_id")
        else:
            sel.append(c)
    return f"SELECT game_id, play_id, nfl_id, {', '.join(sel)} FROM last_state"


STATE_CTES = [
    ("last_state", _last_state_sql(drop_week=True)),
    ("state_in", _state_renamed_sql()),
    ("samples", "SELECT o.*, s.* EXCLUDE (game_id, play_id, nfl_id), "
                "concat_ws('_', o.game_id, o.play_id, o.nfl_id, o.frame_id) AS id "
                "FROM outp o LEFT JOIN state_in s USING (game_id, play_id, nfl_id) "
                "WHERE s.player_to_predict"),
    ("scoring", "SELECT t.*, s.* EXCLUDE (game_id, play_id, nfl_id) "
                "FROM test_rows t LEFT JOIN state_in s USING (game_id, play_id, nfl_id)"),
]


def pmod(expr: str, m: float = 360.0) -> str:
    """Floored modulo in DuckDB (its % truncates)."""
    return f"((({expr}) % {m}) + {m}) % {m}"


def nn_least(*args: str) -> str:
    """least() that is NULL when any argument is NULL."""
    cond = " OR ".join(f"({a}) IS NULL" for a in args)
    return f"CASE WHEN {cond} THEN NULL ELSE least({', '.join(args)}) END"


def nn_greatest(*args: str) -> str:
    cond = " OR ".join(f"({a}) IS NULL" for a in args)
    return f"CASE WHEN {cond} THEN NULL ELSE greatest({', '.join(args)}) END"


def flag(pred: str) -> str:
    return f"CAST(coalesce({pred}, false) AS INTEGER)"


def r6(expr: str, name: str) -> str:
    """Six places; moving averages are settled to nine first, as ties of the sixth are common among them."""
    return f"round(round({expr}, 9), 6) AS {name}" if name.endswith("_ema") else f"round({expr}, 6) AS {name}"


def build(ctes: list[tuple[str, str]], final: str) -> str:
    body = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes)
    rec = "RECURSIVE " if any(" UNION ALL " in s and n.startswith("r(") for n, s in ctes) else ""
    return f"WITH {rec}{body}\n{final}"


# ---------------------------------------------------------------- family A
FEATA_SQL = f"""
SELECT *,
  s_input * cos(radians(dir_input)) AS vx,
  s_input * sin(radians(dir_input)) AS vy,
  sqrt((x_input - ball_land_x) ** 2 + (y_input - ball_land_y) ** 2) AS dist_to_ball_landing,
  x_input - absolute_yardline_number AS dist_from_los,
  {nn_least('y_input', '53.3 - y_input')} AS dist_to_near_sideline,
  abs(y_input - 26.65) AS dist_from_center,
  degrees(atan2(ball_land_y - y_input, ball_land_x - x_input)) AS angle_to_ball,
  abs({pmod('dir_input - degrees(atan2(ball_land_y - y_input, ball_land_x - x_input)) + 180')} - 180) AS pursuit_angle,
  abs({pmod('o_input - dir_input + 180')} - 180) AS body_alignment,
  {flag("player_side = 'Offense'")} AS is_offense,
  {flag("player_side = 'Defense'")} AS is_defense,
  {flag("player_position IN ('WR', 'TE')")} AS is_receiver,
  {flag("player_position IN ('CB', 'SS', 'FS', 'DB', 'S')")} AS is_db,
  {flag("player_position IN ('LB', 'ILB', 'OLB', 'MLB')")} AS is_lb,
  {flag("play_direction = 'right'")} AS play_dir_right,
  frame_id / {nn_greatest('CAST(num_frames_output AS DOUBLE)', '1.0')} AS frame_progress,
  x - x_input AS target_displacement_x,
  y - y_input AS target_displacement_y,
  sqrt((x - x_input) ** 2 + (y - y_input) ** 2) AS target_displacement_dist
FROM samples
"""

FEATA_OUT = [
    "x_input", "y_input", "s_input", "a_input", "dir_input", "o_input", "vx", "vy",
    "dist_to_ball_landing", "dist_from_los", "dist_to_near_sideline", "dist_from_center",
    "angle_to_ball", "pursuit_angle", "body_alignment", "frame_progress",
    "target_displacement_x", "target_displacement_y", "target_displacement_dist",
]
FEATA_INT = ["facing_ball", "is_offense", "is_defense", "is_receiver", "is_db", "is_lb",
             "play_dir_right"]

PHYS_SQL = f"""
SELECT id, game_id, play_id,
  {nn_least(nn_greatest('coalesce(x_input + s_input * cos(radians(dir_input)) * (0.1 * frame_id), x_input, 50.0)', '0.0'), '120.0')} AS x,
  {nn_least(nn_greatest('coalesce(y_input + s_input * sin(radians(dir_input)) * (0.1 * frame_id), y_input, 26.65)', '0.0'), '53.3')} AS y,
  x_input IS NULL AS fallback
FROM scoring
"""


# ------------------------------------------------------------- family B
RIGHT = "coalesce(play_direction = 'right', false)"
UNI_SQL = f"""
SELECT game_id, play_id, nfl_id, frame_id, player_to_predict, play_direction, absolute_yardline_number,
  player_height, player_weight, player_position, player_side, player_role, s, a, num_frames_output, week,
  CASE WHEN {RIGHT} THEN 120.0 - x ELSE x END AS x,
  CASE WHEN {RIGHT} THEN 53.3 - y ELSE y END AS y,
  CASE WHEN {RIGHT} THEN {pmod('dir + 180.0')} ELSE dir END AS dir,
  CASE WHEN {RIGHT} THEN {pmod('o + 180.0')} ELSE o END AS o,
  CASE WHEN {RIGHT} THEN 120.0 - ball_land_x ELSE ball_land_x END AS ball_land_x,
  CASE WHEN {RIGHT} THEN 53.3 - ball_land_y ELSE ball_land_y END AS ball_land_y
FROM inp
"""

HEIGHT_SQL = """CASE WHEN len(string_split(player_height, '-')) = 2
  AND TRY_CAST(string_split(player_height, '-')[1] AS INTEGER) IS NOT NULL
  AND TRY_CAST(string_split(player_height, '-')[2] AS INTEGER) IS NOT NULL
  THEN TRY_CAST(string_split(player_height, '-')[1] AS INTEGER)
     + CAST(TRY_CAST(string_split(player_height, '-')[2] AS INTEGER) AS DOUBLE) / 12.0
  ELSE 6.0 END"""

BASE1_SQL = f"""
SELECT *, {HEIGHT_SQL} AS player_height_feet,
  (s + 0.5 * a * 0.1) * sin(radians(coalesce(dir, 0.0))) AS velocity_x,
  (s + 0.5 * a * 0.1) * cos(radians(coalesce(dir, 0.0))) AS velocity_y,
  a * sin(radians(coalesce(dir, 0.0))) AS acceleration_x,
  a * cos(radians(coalesce(dir, 0.0))) AS acceleration_y,
  {flag("player_side = 'Offense'")} AS is_offense,
  {flag("player_side = 'Defense'")} AS is_defense,
  {flag("player_role = 'Targeted Receiver'")} AS is_receiver,
  {flag("player_role = 'Defensive Coverage'")} AS is_coverage,
  {flag("player_role = 'Passer'")} AS is_passer,
  coalesce(player_weight, 200.0) / 2.20462 AS mass_kg,
  sqrt((ball_land_x - x) ** 2 + (ball_land_y - y) ** 2) AS distance_to_ball,
  atan2(ball_land_y - y, ball_land_x - x) AS angle_to_ball
FROM uni
"""

BASE_SQL = """
SELECT * EXCLUDE (mass_kg),
  velocity_x * mass_kg AS momentum_x,
  velocity_y * mass_kg AS momentum_y,
  0.5 * mass_kg * s ** 2 AS kinetic_energy,
  (ball_land_x - x) / (distance_to_ball + 1e-6) AS ball_direction_x,
  (ball_land_y - y) / (distance_to_ball + 1e-6) AS ball_direction_y,
  velocity_x * ((ball_land_x - x) / (distance_to_ball + 1e-6))
    + velocity_y * ((ball_land_y - y) / (distance_to_ball + 1e-6)) AS ball_closing_speed
FROM base1
"""

W = "OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id)"


def rows_back(n: int) -> str:
    return (f"OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id "
            f"ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)")


def dfill(c: str) -> str:
    return f"coalesce({c} - lag({c}, 1) {W}, 0.0)"


def _ema_ctes() -> list[tuple[str, str]]:
    """EMA as a recursive CTE over the 0-based frame index, carrying (value,
    weight) per series with the null rule: a null keeps the value and decays
    the weight."""
    def step(c: str, w: str, ow: str) -> str:
        old = f"(r.{ow} * CAST(0.7 AS DOUBLE))"
        val = (f"CASE WHEN r.{w} IS NULL THEN s.{c} WHEN s.{c} IS NULL THEN r.{w} "
               f"WHEN r.{w} = s.{c} THEN r.{w} "
               f"ELSE ({old} * r.{w} + CAST(0.3 AS DOUBLE) * s.{c}) / ({old} + CAST(0.3 AS DOUBLE)) END")
        wt = (f"CASE WHEN r.{w} IS NULL THEN CAST(1.0 AS DOUBLE) WHEN s.{c} IS NULL THEN {old} "
              f"ELSE CAST(1.0 AS DOUBLE) END")
        return f"{val}, {wt}"
    series = [("velocity_x", "w1", "o1"), ("velocity_y", "w2", "o2"), ("s", "w3", "o3")]
    seed = ", ".join(f"{c}, CAST(1.0 AS DOUBLE)" for c, _, _ in series)
    steps = ", ".join(step(c, w, o) for c, w, o in series)
    rec = (f"SELECT game_id, play_id, nfl_id, rn, frame_id, {seed} FROM seq WHERE rn = 0 "
           f"UNION ALL SELECT s.game_id, s.play_id, s.nfl_id, s.rn, s.frame_id, {steps} "
           "FROM r JOIN seq s ON s.game_id = r.game_id AND s.play_id = r.play_id "
           "AND s.nfl_id = r.nfl_id AND s.rn = r.rn + 1")
    return [("seq", f"SELECT *, row_number() {W} - 1 AS rn FROM base"),
            ("r(game_id, play_id, nfl_id, rn, frame_id, w1, o1, w2, o2, w3, o3)", rec)]


EMA_CTES = _ema_ctes()
B_CTES = [("uni", UNI_SQL), ("base1", BASE1_SQL), ("base", BASE_SQL)]
FK = "game_id, play_id, nfl_id, frame_id"


def _family_b(q: dict[str, str]) -> None:
    base = BASE_CTES + B_CTES
    q["direction_unify"] = build(
        base, f"SELECT {FK}, " + ", ".join(r6(c, c) for c in
                                            ["x", "y", "dir", "o", "ball_land_x", "ball_land_y"]) + " FROM uni")
    q["direction_roundtrip"] = build(
        BASE_CTES + [
            ("dmap", "SELECT DISTINCT game_id, play_id, play_direction FROM inp"),
            ("u", f"SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id, d.play_direction, "
                  f"CASE WHEN coalesce(d.play_direction = 'right', false) THEN 120.0 - o.x ELSE o.x END AS x_u, "
                  f"CASE WHEN coalesce(d.play_direction = 'right', false) THEN 53.3 - o.y ELSE o.y END AS y_u "
                  f"FROM outp o LEFT JOIN dmap d USING (game_id, play_id)")],
        f"SELECT {FK}, play_direction, round(x_u, 6) AS x_u, round(y_u, 6) AS y_u, "
        f"round(CASE WHEN {RIGHT} THEN 120.0 - x_u ELSE x_u END, 6) AS x, "
        f"round(CASE WHEN {RIGHT} THEN 53.3 - y_u ELSE y_u END, 6) AS y FROM u")
    base_cols = ["player_height_feet", "velocity_x", "velocity_y", "acceleration_x", "acceleration_y",
                 "momentum_x", "momentum_y", "kinetic_energy", "distance_to_ball", "angle_to_ball",
                 "ball_direction_x", "ball_direction_y", "ball_closing_speed"]
    q["features_b_base"] = build(
        base, f"SELECT {FK}, " + ", ".join(r6(c, c) for c in base_cols)
        + ", is_offense, is_defense, is_receiver, is_coverage, is_passer FROM base")
    q["height_parse"] = build(
        BASE_CTES, f"SELECT DISTINCT game_id, play_id, nfl_id, player_height, "
                   f"round({HEIGHT_SQL}, 6) AS player_height_feet FROM inp")
    lags = [f"round(lag({c}, {k}) {W}, 6) AS {c}_lag{k}" for k in range(1, 6)
            for c in ("x", "y", "velocity_x", "velocity_y")]
    q["lag_features"] = build(base, f"SELECT {FK}, {', '.join(lags)} FROM base")

    q["ema_features"] = build(base + EMA_CTES, f"SELECT {FK}, {r6('w1', 'velocity_x_ema')}, "
                              f"{r6('w2', 'velocity_y_ema')}, {r6('w3', 'speed_ema')} FROM r")
    q["rolling_mean"] = build(
        base, f"SELECT {FK}, round(avg(velocity_x) {rows_back(12)}, 6) AS velocity_x_roll, "
              f"round(avg(velocity_y) {rows_back(12)}, 6) AS velocity_y_roll FROM base")
    multi = []
    for n in (3, 6, 9):
        for c in ("velocity_x", "velocity_y", "s", "a"):
            multi.append(f"round(avg({c}) {rows_back(n)}, 6) AS {c}_roll{n}")
            multi.append(f"round(coalesce(stddev_samp({c}) {rows_back(n)}, 0.0), 6) AS {c}_std{n}")
    q["rolling_multi"] = build(base, f"SELECT {FK}, {', '.join(multi)} FROM base")

    diff_cte = ("diffs", f"""SELECT *, {dfill('distance_to_ball')} AS distance_to_ball_change,
        {dfill('velocity_x')} AS velocity_x_change, {dfill('velocity_y')} AS velocity_y_change,
        {dfill('s')} AS speed_change, {dfill('dir')} AS dir_diff FROM base""")
    diff2_cte = ("diffs2", f"""SELECT * EXCLUDE (dir_diff), {dfill('distance_to_ball_change')} AS distance_to_ball_accel,
        CASE WHEN abs(dir_diff) < 180 THEN dir_diff ELSE dir_diff - 360.0 * sign(dir_diff) END AS direction_change
        FROM diffs""")
    diffs = ["distance_to_ball_change", "distance_to_ball_accel", "velocity_x_change",
             "velocity_y_change", "speed_change", "direction_change"]
    q["diff_features"] = build(base + [diff_cte, diff2_cte],
                               f"SELECT {FK}, {', '.join(r6(c, c) for c in diffs)} FROM diffs2")
    adv = f"""SELECT *,
      {nn_least(nn_greatest('distance_to_ball / (abs(distance_to_ball_change) + 0.1)', '0.0'), '10.0')} AS time_to_intercept,
      velocity_x * ball_direction_x + velocity_y * ball_direction_y AS velocity_alignment,
      velocity_x * (-ball_direction_y) + velocity_y * ball_direction_x AS velocity_perpendicular,
      acceleration_x * ball_direction_x + acceleration_y * ball_direction_y AS accel_alignment,
      y AS dist_from_left, 53.3 - y AS dist_from_right,
      {nn_least('y', '53.3 - y')} AS dist_from_sideline,
      {nn_least('x', '120.0 - x')} AS dist_from_endzone,
      is_receiver * (velocity_x * ball_direction_x + velocity_y * ball_direction_y) AS receiver_optimality,
      is_receiver * abs(velocity_x * (-ball_direction_y) + velocity_y * ball_direction_x) AS receiver_deviation,
      is_coverage * ball_closing_speed AS defender_closing_speed,
      CAST(row_number() {W} - 1 AS BIGINT) AS frames_elapsed,
      (row_number() {W} - 1) / count(*) OVER (PARTITION BY game_id, play_id, nfl_id) AS normalized_time,
      s ** 2 AS speed_squared,
      sqrt(acceleration_x ** 2 + acceleration_y ** 2) AS accel_magnitude,
      {nn_least('abs(o - dir)', '360.0 - abs(o - dir)')} AS orientation_diff
    FROM diffs2"""
    adv_cols = ["time_to_intercept", "velocity_alignment", "velocity_perpendicular", "accel_alignment",
                "dist_from_left", "dist_from_right", "dist_from_sideline", "dist_from_endzone",
                "receiver_optimality", "receiver_deviation", "defender_closing_speed",
                "normalized_time", "speed_squared", "accel_magnitude", "orientation_diff"]
    q["advanced_features"] = build(base + [diff_cte, diff2_cte, ("adv", adv)],
                                   f"SELECT {FK}, {', '.join(r6(c, c) for c in adv_cols)}, frames_elapsed FROM adv")
    q["jerk"] = build(base, f"SELECT {FK}, round({dfill('a')} * 0.1, 6) AS jerk, "
                            f"round({dfill('acceleration_x')} * 0.1, 6) AS jerk_x, "
                            f"round({dfill('acceleration_y')} * 0.1, 6) AS jerk_y FROM base")
    curv1 = f"""SELECT *,
      degrees(atan2(sin(atan2(ball_land_y - y, ball_land_x - x) - radians(coalesce(dir, 0.0))),
                    cos(atan2(ball_land_y - y, ball_land_x - x) - radians(coalesce(dir, 0.0))))) AS bearing_to_land_signed,
      (ball_land_y - y) * cos(radians(coalesce(dir, 0.0))) - (ball_land_x - x) * sin(radians(coalesce(dir, 0.0))) AS land_lateral_offset,
      coalesce(radians({pmod(dfill('dir') + ' + 180.0')} - 180.0) / (CASE WHEN s <> 0 THEN s END * 0.1 + 1e-6), 0.0) AS curvature_signed
    FROM base"""
    curv2 = f"""SELECT *, abs(curvature_signed) AS curvature_abs FROM curv1"""
    curv_final = (f"SELECT {FK}, round(bearing_to_land_signed, 6) AS bearing_to_land_signed, "
                  "round(land_lateral_offset, 6) AS land_lateral_offset, "
                  "round(curvature_signed, 6) AS curvature_signed, round(curvature_abs, 6) AS curvature_abs, "
                  + ", ".join(f"round(avg(curvature_{k}) {rows_back(n)}, 6) AS curv_{k}_roll{n}"
                              for n in (3, 5) for k in ("signed", "abs"))
                  + " FROM curv2")
    q["curvature"] = build(base + [("curv1", curv1), ("curv2", curv2)], curv_final)
    q["elapsed_time"] = build(
        BASE_CTES, f"SELECT {FK}, CAST(row_number() {W} - 1 AS BIGINT) AS frames_elapsed, "
                   f"round((row_number() {W} - 1) / count(*) OVER (PARTITION BY game_id, play_id, nfl_id), 6) "
                   "AS normalized_time FROM inp")


# ------------------------------------------------------------ interactions
def _opp_ctes() -> list[tuple[str, str]]:
    """Opponent and mirror features per player, over the base CTE (all pairs: oracle only)."""
    ls = ("ls", "SELECT game_id, play_id, nfl_id, arg_max(x, frame_id) AS x, arg_max(y, frame_id) AS y, "
                "arg_max(s, frame_id) AS s, arg_max(dir, frame_id) AS dir, "
                "arg_max(player_side, frame_id) AS player_side, arg_max(player_role, frame_id) AS player_role "
                "FROM base GROUP BY game_id, play_id, nfl_id")
    lsn = ("lsn", "SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY game_id, play_id) AS n FROM ls) WHERE n >= 2")
    pairs = ("opp_pairs", """SELECT a.game_id, a.play_id, a.nfl_id, b.nfl_id AS oid,
        sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, a.x - b.x AS tx, a.y - b.y AS ty,
        a.s * sin(radians(a.dir)) - b.s * sin(radians(b.dir)) AS rvx,
        a.s * cos(radians(a.dir)) - b.s * cos(radians(b.dir)) AS rvy
      FROM lsn a JOIN lsn b ON a.game_id = b.game_id AND a.play_id = b.play_id
        AND a.player_side IS DISTINCT FROM b.player_side
      WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL""")
    nearest = ("opp_near", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id
        ORDER BY dist, oid) AS rk FROM opp_pairs) WHERE rk = 1""")
    counts = ("opp_cnt", """SELECT game_id, play_id, nfl_id, count(*) FILTER (WHERE dist < 3.0) AS c3,
        count(*) FILTER (WHERE dist < 5.0) AS c5 FROM opp_pairs GROUP BY game_id, play_id, nfl_id""")
    mpairs = ("mir_pairs", """SELECT a.game_id, a.play_id, a.nfl_id, b.nfl_id AS rid,
        sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS dist, a.x - b.x AS ox, a.y - b.y AS oy,
        b.s * sin(radians(b.dir)) AS rvx, b.s * cos(radians(b.dir)) AS rvy
      FROM lsn a JOIN lsn b ON a.game_id = b.game_id AND a.play_id = b.play_id
      WHERE a.player_role = 'Defensive Coverage' AND b.player_role IN ('Targeted Receiver', 'Other Route Runner')
        AND a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL""")
    mnear = ("mir_near", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id
        ORDER BY dist, rid) AS rk FROM mir_pairs) WHERE rk = 1""")
    opp = ("opp", """SELECT l.game_id, l.play_id, l.nfl_id,
        CASE WHEN n.dist IS NULL THEN 50.0 ELSE n.dist END AS nearest_opp_dist,
        CASE WHEN n.dist IS NULL THEN 0.0 ELSE -(n.rvx * (n.tx / (sqrt(n.tx ** 2 + n.ty ** 2) + 0.1))
             + n.rvy * (n.ty / (sqrt(n.tx ** 2 + n.ty ** 2) + 0.1))) END AS opp_closing_speed,
        CAST(coalesce(c.c3, 0) AS BIGINT) AS num_nearby_opp_3, CAST(coalesce(c.c5, 0) AS BIGINT) AS num_nearby_opp_5,
        CASE WHEN n.dist IS NOT NULL AND m.dist IS NOT NULL THEN m.rvx ELSE 0.0 END AS mirror_wr_vx,
        CASE WHEN n.dist IS NOT NULL AND m.dist IS NOT NULL THEN m.rvy ELSE 0.0 END AS mirror_wr_vy,
        CASE WHEN n.dist IS NOT NULL AND m.dist IS NOT NULL THEN m.ox ELSE 0.0 END AS mirror_offset_x,
        CASE WHEN n.dist IS NOT NULL AND m.dist IS NOT NULL THEN m.oy ELSE 0.0 END AS mirror_offset_y,
        CASE WHEN n.dist IS NOT NULL AND m.dist IS NOT NULL THEN m.dist ELSE 50.0 END AS mirror_wr_dist
      FROM lsn l LEFT JOIN opp_near n USING (game_id, play_id, nfl_id)
        LEFT JOIN opp_cnt c USING (game_id, play_id, nfl_id)
        LEFT JOIN mir_near m USING (game_id, play_id, nfl_id)""")
    return [ls, lsn, pairs, nearest, counts, mpairs, mnear, opp]


def _interactions(q: dict[str, str]) -> None:
    base = BASE_CTES + B_CTES
    octes = base + _opp_ctes()
    q["nearest_opponent"] = build(octes, "SELECT game_id, play_id, nfl_id, round(nearest_opp_dist, 6) AS nearest_opp_dist, "
                                         "round(opp_closing_speed, 6) AS opp_closing_speed, num_nearby_opp_3, num_nearby_opp_5 FROM opp")
    q["mirror_receiver"] = build(octes, "SELECT game_id, play_id, nfl_id, " + ", ".join(
        r6(c, c) for c in ["mirror_wr_vx", "mirror_wr_vy", "mirror_offset_x", "mirror_offset_y", "mirror_wr_dist"])
        + " FROM opp")
    qb = ("qbp", """SELECT game_id, play_id, frame_id, arg_min(x, nfl_id) AS qx, arg_min(y, nfl_id) AS qy
        FROM base WHERE player_role = 'Passer' GROUP BY game_id, play_id, frame_id""")
    qb2 = ("qb2", """SELECT b.*, sqrt((b.x - p.qx) * (b.x - p.qx) + (b.y - p.qy) * (b.y - p.qy)) + 1e-6 AS qd,
        b.x - p.qx AS dx, b.y - p.qy AS dy FROM base b LEFT JOIN qbp p USING (game_id, play_id, frame_id)""")
    qb3 = ("qb3", """SELECT *, velocity_x * (dx / qd) + velocity_y * (dy / qd) AS al,
        velocity_x * (-(dy / qd)) + velocity_y * (dx / qd) AS pe,
        degrees(atan2(sin(atan2(-dy, -dx) - radians(coalesce(dir, 0.0))), cos(atan2(-dy, -dx) - radians(coalesce(dir, 0.0))))) AS br
        FROM qb2""")
    q["qb_relative"] = build(base + [qb, qb2, qb3], f"""SELECT {FK}, round(qd, 6) AS qb_distance,
        round(al, 6) AS vel_to_qb_alignment, round(pe, 6) AS vel_to_qb_perp, round(br, 6) AS bearing_to_qb_signed,
        round(sin(radians(br)), 6) AS bearing_to_qb_sin, round(cos(radians(br)), 6) AS bearing_to_qb_cos FROM qb3""")
    st = BASE_CTES + STATE_CTES
    edges = ("edges", """SELECT a.game_id, a.play_id, a.frame_id, a.nfl_id AS src, b.nfl_id AS dst,
        sqrt((a.x_input - b.x_input) ** 2 + (a.y_input - b.y_input) ** 2) AS dist
      FROM samples a JOIN samples b ON a.game_id = b.game_id AND a.play_id = b.play_id AND a.frame_id = b.frame_id
      WHERE sqrt((a.x_input - b.x_input) ** 2 + (a.y_input - b.y_input) ** 2) < 15.0""")
    wedges = ("wedges", """SELECT *, 1.0 / (count(*) OVER (PARTITION BY game_id, play_id, frame_id, src) + 1e-8) AS weight
        FROM edges""")
    q["radius_graph"] = build(st + [edges, wedges], "SELECT game_id, play_id, frame_id, src, dst, "
                                                     "round(dist, 6) AS dist, round(weight, 6) AS weight FROM wedges")
    feats = ["x_input", "y_input", "s_input", "vx", "vy"]
    nodes = ("nodes", "SELECT game_id, play_id, frame_id, nfl_id, x_input, y_input, s_input, "
                      "s_input * cos(radians(dir_input)) AS vx, s_input * sin(radians(dir_input)) AS vy FROM samples")
    msg = ("msg", "SELECT e.game_id, e.play_id, e.frame_id, e.src AS nfl_id, "
                  + ", ".join(f"sum(e.weight * n.{f}) AS nbr_{f}" for f in feats)
                  + " FROM wedges e JOIN nodes n ON n.game_id = e.game_id AND n.play_id = e.play_id "
                    "AND n.frame_id = e.frame_id AND n.nfl_id = e.dst GROUP BY e.game_id, e.play_id, e.frame_id, e.src")
    hops = [("hop0", "SELECT game_id, play_id, frame_id, nfl_id, " + ", ".join(f"coalesce({f}, 0.0) AS {f}" for f in feats) + " FROM nodes")]
    for k in (1, 2, 3):
        hops.append((f"hop{k}", "SELECT n.game_id, n.play_id, n.frame_id, n.nfl_id, " + ", ".join(f"coalesce(sum(e.weight * h.{f}), 0.0) AS {f}" for f in feats)
                     + f" FROM nodes n LEFT JOIN wedges e ON e.game_id = n.game_id AND e.play_id = n.play_id AND e.frame_id = n.frame_id AND e.src = n.nfl_id"
                     f" LEFT JOIN hop{k - 1} h ON h.game_id = e.game_id AND h.play_id = e.play_id AND h.frame_id = e.frame_id AND h.nfl_id = e.dst"
                     " GROUP BY n.game_id, n.play_id, n.frame_id, n.nfl_id"))
    q["message_passing"] = build(st + [edges, wedges, nodes, *hops], "SELECT game_id, play_id, frame_id, nfl_id, "
                                 + ", ".join(f"round(h{k}.{f}, 6) AS hop{k}_{f}" for k in (1, 2, 3) for f in feats)
                                 + " FROM hop1 h1 JOIN hop2 h2 USING (game_id, play_id, frame_id, nfl_id) JOIN hop3 h3 USING (game_id, play_id, frame_id, nfl_id)")
    vel = {"x_input": "x_input", "y_input": "y_input", "s_input": "s_input", "vx": "s_input * cos(radians(dir_input))", "vy": "s_input * sin(radians(dir_input))"}
    q["graph_nodes"] = build(st, "SELECT game_id, play_id, frame_id, nfl_id, 5 AS width, " + ", ".join(r6(e, f"f_{c}") for c, e in vel.items()) + ", x, y FROM samples")
    q["single_step"] = build(st, "SELECT id, 1 AS steps, " + ", ".join(r6(f"coalesce({e}, 0.0)", f"f_{c}") for c, e in vel.items()) + " FROM samples")
    q["neighbour_mean"] = build(
        st + [edges, wedges, nodes, msg],
        "SELECT n.game_id, n.play_id, n.frame_id, n.nfl_id, "
        + ", ".join(f"round(coalesce(m.nbr_{f}, 0.0), 6) AS nbr_{f}" for f in feats)
        + " FROM nodes n LEFT JOIN msg m USING (game_id, play_id, frame_id, nfl_id)")


def oracle_queries() -> dict[str, str]:
    q: dict[str, str] = {}
    base = BASE_CTES
    st = BASE_CTES + STATE_CTES

    q["last_state"] = build(base + [("ls", _last_state_sql())], "SELECT * FROM ls")
    q["training_samples"] = build(st, "SELECT * FROM samples")

    feat_sel = ", ".join(
        ["id", "game_id", "play_id", "nfl_id", "frame_id"]
        + [r6(c, c) for c in FEATA_OUT]
        + [f"{flag('pursuit_angle < 45')} AS facing_ball"]
        + [c for c in FEATA_INT if c != "facing_ball"]
        + ["ball_land_x", "ball_land_y", "num_frames_output"]
    )
    q["features_a"] = build(st + [("fa", FEATA_SQL)], f"SELECT {feat_sel} FROM fa")

    q["physics_baseline"] = build(
        st + [("phys", PHYS_SQL)],
        "SELECT id, game_id, play_id, round(x, 6) AS x, round(y, 6) AS y, fallback FROM phys")

    q["rmse_score"] = build(
        st + [("phys", PHYS_SQL),
              ("pairs", "SELECT o.x AS x_true, o.y AS y_true, p.x AS x_pred, p.y AS y_pred "
                        "FROM (SELECT *, concat_ws('_', game_id, play_id, nfl_id, frame_id) AS id FROM outp) o "
                        "JOIN phys p USING (id)")],
        "SELECT round(sqrt(0.5 * (avg((x_true - x_pred) ** 2) + avg((y_true - y_pred) ** 2))), 6) AS rmse, "
        "round(sqrt(avg((x_true - x_pred) ** 2)), 6) AS rmse_x, "
        "round(sqrt(avg((y_true - y_pred) ** 2)), 6) AS rmse_y, "
        "count(*) AS n_pairs FROM pairs")
    _family_b(q)
    _interactions(q)
    _sequences(q)
    _quality(q)
    q["play_order"] = build(BASE_CTES, "SELECT game_id, play_id, min(event_id) AS first_seen FROM trk "
                                       "GROUP BY game_id, play_id")
    q["stream_last_state"] = q["last_state"]
    q["stream_score"] = q["physics_baseline"]
    return q


# ------------------------------------------------------------ sequences
def _feature_list_b() -> list[str]:
    from trackframe.operators.features_b import FEATURES_B
    out = []
    for c in FEATURES_B:
        if c not in ("velocity_x_delta", "velocity_y_delta") and c not in out:
            out.append(c)
    return out


def _feat_b_ctes() -> list[tuple[str, str]]:
    """The whole family-B feature table (q1) as CTEs ending in ``fb``."""
    lags = [f"lag({c}, {k}) {W} AS {c}_lag{k}" for k in range(1, 6) for c in ("x", "y", "velocity_x", "velocity_y")]
    lr = ("lr", f"SELECT {FK}, {', '.join(lags)}, avg(velocity_x) {rows_back(12)} AS velocity_x_roll, "
                f"avg(velocity_y) {rows_back(12)} AS velocity_y_roll FROM base")
    diff_cte = ("diffs", f"""SELECT *, {dfill('distance_to_ball')} AS distance_to_ball_change,
        {dfill('velocity_x')} AS velocity_x_change, {dfill('velocity_y')} AS velocity_y_change,
        {dfill('s')} AS speed_change, {dfill('dir')} AS dir_diff FROM base""")
    diff2_cte = ("diffs2", f"""SELECT * EXCLUDE (dir_diff), {dfill('distance_to_ball_change')} AS distance_to_ball_accel,
        CASE WHEN abs(dir_diff) < 180 THEN dir_diff ELSE dir_diff - 360.0 * sign(dir_diff) END AS direction_change
        FROM diffs""")
    adv = ("adv", f"""SELECT *,
      {nn_least(nn_greatest('distance_to_ball / (abs(distance_to_ball_change) + 0.1)', '0.0'), '10.0')} AS time_to_intercept,
      velocity_x * ball_direction_x + velocity_y * ball_direction_y AS velocity_alignment,
      velocity_x * (-ball_direction_y) + velocity_y * ball_direction_x AS velocity_perpendicular,
      acceleration_x * ball_direction_x + acceleration_y * ball_direction_y AS accel_alignment,
      {nn_least('y', '53.3 - y')} AS dist_from_sideline,
      {nn_least('x', '120.0 - x')} AS dist_from_endzone,
      is_receiver * (velocity_x * ball_direction_x + velocity_y * ball_direction_y) AS receiver_optimality,
      is_receiver * abs(velocity_x * (-ball_direction_y) + velocity_y * ball_direction_x) AS receiver_deviation,
      is_coverage * ball_closing_speed AS defender_closing_speed,
      CAST(row_number() {W} - 1 AS BIGINT) AS frames_elapsed,
      (row_number() {W} - 1) / count(*) OVER (PARTITION BY game_id, play_id, nfl_id) AS normalized_time
    FROM diffs2""")
    fb = ("fb", f"""SELECT a.*, lr.* EXCLUDE (game_id, play_id, nfl_id, frame_id),
        r.w1 AS velocity_x_ema, r.w2 AS velocity_y_ema, r.w3 AS speed_ema,
        o.* EXCLUDE (game_id, play_id, nfl_id),
        1.0 / {nn_greatest('o.nearest_opp_dist', '0.5')} AS pressure,
        {flag('o.nearest_opp_dist < 3')} AS under_pressure,
        (1.0 / {nn_greatest('o.nearest_opp_dist', '0.5')}) * a.s AS pressure_x_speed,
        (a.velocity_x * o.mirror_wr_vx + a.velocity_y * o.mirror_wr_vy) / {nn_greatest('a.s', '0.1')} AS mirror_similarity,
        sqrt(o.mirror_offset_x ** 2 + o.mirror_offset_y ** 2) AS mirror_offset_dist,
        ((a.velocity_x * o.mirror_wr_vx + a.velocity_y * o.mirror_wr_vy) / {nn_greatest('a.s', '0.1')}) * a.is_coverage
          AS mirror_alignment
      FROM adv a JOIN lr USING (game_id, play_id, nfl_id, frame_id)
        JOIN r USING (game_id, play_id, nfl_id, frame_id)
        LEFT JOIN opp o USING (game_id, play_id, nfl_id)""")
    return B_CTES + [lr] + EMA_CTES + _opp_ctes() + [diff_cte, diff2_cte, adv, fb]


def _window_ctes(keys_cte: str, prefix: str) -> list[tuple[str, str]]:
    cols = _feature_list_b()
    means = ", ".join(f"avg(CAST({c} AS DOUBLE)) OVER (PARTITION BY game_id, play_id, nfl_id) AS m_{c}" for c in cols)
    return [
        (f"{prefix}ff", f"SELECT fb.* FROM fb JOIN {keys_cte} USING (game_id, play_id, nfl_id)"),
        (f"{prefix}fm", f"SELECT *, {means}, row_number() OVER (PARTITION BY game_id, play_id, nfl_id "
                        f"ORDER BY frame_id DESC) AS rd, count(*) OVER (PARTITION BY game_id, play_id, nfl_id) AS gr "
                        f"FROM {prefix}ff"),
    ]


def _sequences(q: dict[str, str]) -> None:
    cols = _feature_list_b()
    base = BASE_CTES + _feat_b_ctes()
    q["tail_window"] = build(
        BASE_CTES + [("tw", "SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id DESC) AS rd, "
                            "count(*) OVER (PARTITION BY game_id, play_id, nfl_id) AS gr FROM inp")],
        "SELECT game_id, play_id, nfl_id, CAST(least(gr, 12) - rd AS INTEGER) AS step, frame_id, gr AS group_rows "
        "FROM tw WHERE rd <= 12")
    train = [("tgt", "SELECT DISTINCT game_id, play_id, nfl_id FROM outp")] + _window_ctes("tgt", "t_") + [
        ("t_w", "SELECT game_id, play_id, nfl_id, CAST(least(gr, 12) - rd AS INTEGER) AS step, play_direction, "
                + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in cols)
                + " FROM t_fm WHERE rd <= 12 AND gr >= 12"),
        ("t_bad", "SELECT DISTINCT game_id, play_id, nfl_id FROM t_w WHERE "
                  + " OR ".join(f"{c} IS NULL" for c in cols)),
        ("t_ok", "SELECT * FROM t_w WHERE NOT EXISTS (SELECT 1 FROM t_bad b WHERE b.game_id = t_w.game_id "
                 "AND b.play_id = t_w.play_id AND b.nfl_id = t_w.nfl_id)"),
    ]
    sel = "game_id, play_id, nfl_id, step, play_direction, " + ", ".join(r6(c, c) for c in cols)
    q["sequence_train"] = build(base + train, f"SELECT {sel} FROM t_ok")
    q["sequence_arrays"] = build(base + train, "SELECT game_id, play_id, nfl_id, count(*) AS steps, " + ", ".join(
        f"round(sum((step + 1) * {c}), 6) AS dot_{c}" for c in ("x", "y", "s", "distance_to_ball", "nearest_opp_dist")) + " FROM t_ok GROUP BY game_id, play_id, nfl_id")
    score = [("req", "SELECT DISTINCT game_id, play_id, nfl_id FROM test_rows")] + _window_ctes("req", "s_") + [
        ("s_w", "SELECT game_id, play_id, nfl_id, CAST(12 - rd AS INTEGER) AS step, play_direction, "
                + ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}, 0.0) AS {c}" for c in cols)
                + " FROM s_fm WHERE rd <= 12 UNION ALL "
                "SELECT game_id, play_id, nfl_id, CAST(unnest(range(0, 12 - gr)) AS INTEGER) AS step, "
                "CAST(NULL AS VARCHAR) AS play_direction, "
                + ", ".join(f"coalesce(m_{c}, 0.0) AS {c}" for c in cols)
                + " FROM s_fm WHERE rd = 1 AND gr < 12"),
    ]
    q["sequence_score"] = build(base + score, f"SELECT {sel} FROM s_w")
    q["target_deltas"] = build(base + train + [
        ("dmap", "SELECT DISTINCT game_id, play_id, play_direction FROM inp"),
        ("ou", f"SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id, d.play_direction, "
               f"CASE WHEN coalesce(d.play_direction = 'right', false) THEN 120.0 - o.x ELSE o.x END AS x, "
               f"CASE WHEN coalesce(d.play_direction = 'right', false) THEN 53.3 - o.y ELSE o.y END AS y "
               f"FROM outp o LEFT JOIN dmap d USING (game_id, play_id)")],
        "SELECT ou.game_id, ou.play_id, ou.nfl_id, ou.frame_id, ou.play_direction, "
        "round(ou.x - t.x, 6) AS dx, round(ou.y - t.y, 6) AS dy FROM ou "
        "JOIN (SELECT game_id, play_id, nfl_id, x, y FROM t_ok WHERE step = 11) t USING (game_id, play_id, nfl_id)")

    hf = ["x_input", "y_input", "s_input", "a_input", "dir_input", "o_input", "vx", "vy",
          "dist_from_los", "frame_progress"]
    prog = nn_greatest("CAST(num_frames_output AS DOUBLE)", "1.0")
    hist = [
        ("hist", f"SELECT game_id, play_id, nfl_id, frame_id, x AS x_input, y AS y_input, s AS s_input, a AS a_input, "
                 f"dir AS dir_input, o AS o_input, s * cos(radians(dir)) AS vx, s * sin(radians(dir)) AS vy, "
                 f"x - absolute_yardline_number AS dist_from_los, frame_id / {prog} AS frame_progress FROM inp"),
        ("hr", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, play_id, nfl_id "
               "ORDER BY frame_id DESC) AS rd FROM hist) WHERE rd <= 99"),
        ("hl", "SELECT game_id, play_id, nfl_id, count(*) AS hist_len FROM hr GROUP BY game_id, play_id, nfl_id"),
        ("smp", f"SELECT id, game_id, play_id, nfl_id, x_input, y_input, s_input, a_input, dir_input, o_input, "
                f"s_input * cos(radians(dir_input)) AS vx, s_input * sin(radians(dir_input)) AS vy, "
                f"x_input - absolute_yardline_number AS dist_from_los, frame_id / {prog} AS frame_progress, "
                f"coalesce(hl.hist_len, 0) AS hist_len FROM samples LEFT JOIN hl USING (game_id, play_id, nfl_id)"),
        ("hs", f"SELECT id, game_id, play_id, nfl_id, CAST(99 AS INTEGER) AS pos, {', '.join(hf)} FROM smp "
               f"UNION ALL SELECT s.id, s.game_id, s.play_id, s.nfl_id, CAST(99 - h.rd AS INTEGER) AS pos, "
               + ", ".join(f"h.{c}" for c in hf)
               + " FROM smp s JOIN hr h USING (game_id, play_id, nfl_id) "
               "UNION ALL SELECT id, game_id, play_id, nfl_id, CAST(unnest(range(0, 99 - least(hist_len, 99))) AS INTEGER) AS pos, "
               + ", ".join(f"0.0 AS {c}" for c in hf) + " FROM smp WHERE 98 - least(hist_len, 99) >= 0"),
    ]
    q["history_sequence"] = build(BASE_CTES + STATE_CTES + hist,
                                  "SELECT id, game_id, play_id, nfl_id, pos, " + ", ".join(r6(c, c) for c in hf) + " FROM hs")
    places = ", ".join(f"round(sum({c} * (pos + 1)), 6) AS dot_{c}" for c in hf)
    q["history_arrays"] = build(BASE_CTES + STATE_CTES + hist + [("hp", f"SELECT id, pos, {', '.join(f'coalesce({c}, 0.0) AS {c}' for c in hf)} FROM hs")],
                                f"SELECT id, any_value(smp.hist_len) AS hist_len, {places} FROM hp JOIN (SELECT id, hist_len FROM smp) smp USING (id) GROUP BY id")
    q["trajectory_cumsum"] = build(BASE_CTES + STATE_CTES + [
        ("st", "SELECT o.game_id, o.play_id, o.nfl_id, o.frame_id, o.x, o.y, s.x_input, s.y_input "
               "FROM outp o LEFT JOIN state_in s USING (game_id, play_id, nfl_id)"),
        ("stp", f"SELECT {FK}, x - coalesce(lag(x) {W}, x_input) AS ddx, y - coalesce(lag(y) {W}, y_input) AS ddy FROM st")],
        f"SELECT {FK}, round(sum(ddx) OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_ddx, "
        "round(sum(ddy) OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY frame_id "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cum_ddy FROM stp")
    right = "coalesce(a.play_direction = 'right', false)"
    xu = nn_least(nn_greatest("a.last_x + st.dx", "0.0"), "120.0")
    yu = nn_least(nn_greatest("a.last_y + st.dy", "0.0"), "53.3")
    q["horizon_hold"] = build(BASE_CTES + B_CTES + [
        ("anc", "SELECT game_id, play_id, nfl_id, arg_max(play_direction, frame_id) AS play_direction, "
                "arg_max(x, frame_id) AS last_x, arg_max(y, frame_id) AS last_y, "
                "arg_max(velocity_x, frame_id) AS vx, arg_max(velocity_y, frame_id) AS vy "
                "FROM base WHERE (game_id, play_id, nfl_id) IN (SELECT game_id, play_id, nfl_id FROM test_rows) "
                "GROUP BY game_id, play_id, nfl_id"),
        ("st0", "SELECT game_id, play_id, nfl_id, CAST(unnest(range(0, 94)) AS INTEGER) AS step, vx * 0.1 AS sdx, vy * 0.1 AS sdy FROM anc"),
        ("st", "SELECT game_id, play_id, nfl_id, step, sum(sdx) OVER (PARTITION BY game_id, play_id, nfl_id ORDER BY step "
               "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dx, sum(sdy) OVER (PARTITION BY game_id, play_id, nfl_id "
               "ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS dy FROM st0"),
        ("rq", f"SELECT *, CAST(least(row_number() {W} - 1, 93) AS INTEGER) AS step FROM test_rows")],
        f"SELECT rq.id, rq.game_id, rq.play_id, rq.nfl_id, rq.frame_id, rq.step, "
        f"round({nn_least(nn_greatest(f'CASE WHEN {right} THEN 120.0 - ({xu}) ELSE {xu} END', '0.0'), '120.0')}, 6) AS x, "
        f"round({nn_least(nn_greatest(f'CASE WHEN {right} THEN 53.3 - ({yu}) ELSE {yu} END', '0.0'), '53.3')}, 6) AS y "
        "FROM rq LEFT JOIN st USING (game_id, play_id, nfl_id, step) LEFT JOIN anc a USING (game_id, play_id, nfl_id)")


# ------------------------------------------- quality, profile, scaling, models
FEATA_ALL = ["x_input", "y_input", "s_input", "a_input", "dir_input", "o_input", "vx", "vy",
             "dist_to_ball_landing", "dist_from_los", "dist_to_near_sideline", "dist_from_center",
             "angle_to_ball", "pursuit_angle", "facing_ball", "body_alignment",
             "is_offense", "is_defense", "is_receiver", "is_db", "is_lb", "play_dir_right", "frame_progress",
             "ball_land_x", "ball_land_y", "frame_id", "num_frames_output"]


def _finite(c: str) -> str:
    return (f"CASE WHEN CAST({c} AS DOUBLE) IS NULL OR isnan(CAST({c} AS DOUBLE)) "
            f"OR abs(CAST({c} AS DOUBLE)) = 'inf'::DOUBLE THEN 0.0 ELSE CAST({c} AS DOUBLE) END")


def _quality(q: dict[str, str]) -> None:
    st = BASE_CTES + STATE_CTES
    q["numeric_coerce"] = build(BASE_CTES, f"SELECT {FK}, " + ", ".join(
        f"coalesce(TRY_CAST({c} AS DOUBLE), 0.0) AS {c}" for c in ["player_height", "player_weight", "dir", "o"])
        + " FROM inp")
    fa = ("fa", FEATA_SQL.replace("SELECT *,", f"SELECT *, {flag('abs(' + pmod('dir_input - degrees(atan2(ball_land_y - y_input, ball_land_x - x_input)) + 180') + ' - 180) < 45')} AS facing_ball,", 1))
    fin = ("fin", "SELECT id, " + ", ".join(f"{_finite(c)} AS {c}" for c in FEATA_ALL) + " FROM fa")
    stats = ("stats", "SELECT " + ", ".join(
        f"avg({c}) AS mean_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END AS scale_{c}"
        for c in FEATA_ALL) + " FROM fin")
    q["standard_scale"] = build(st + [fa, fin, stats], "SELECT id, " + ", ".join(
        f"round(({c} - mean_{c}) / scale_{c}, 6) AS {c}" for c in FEATA_ALL) + " FROM fin, stats")
    q["play_split"] = build(st, "SELECT DISTINCT game_id, play_id, "
                                "CAST(('0x' || substr(md5(concat_ws('_', game_id, play_id, '42')), 1, 8)) AS BIGINT) "
                                f"< {int(0.2 * 2 ** 32)} AS is_val FROM samples")
    phys_x = nn_least(nn_greatest("x_input + s_input * cos(radians(dir_input)) * (0.1 * frame_id)", "0.0"), "120.0")
    phys_y = nn_least(nn_greatest("y_input + s_input * sin(radians(dir_input)) * (0.1 * frame_id)", "0.0"), "53.3")
    members = ("members", f"SELECT id, 0.3 AS w, {phys_x} AS x, {phys_y} AS y FROM scoring "
                          "UNION ALL SELECT id, 0.4 AS w, x_input AS x, y_input AS y FROM scoring "
                          "UNION ALL SELECT id, 0.3 AS w, 50.0 AS x, 26.65 AS y FROM scoring")
    q["blend"] = build(st + [members], "SELECT id, round(sum(w * x) / sum(CASE WHEN x IS NOT NULL THEN w END), 6) AS x, "
                                       "round(sum(w * y) / sum(CASE WHEN y IS NOT NULL THEN w END), 6) AS y "
                                       "FROM members GROUP BY id")
    model_rows = ("held", f"""SELECT s.*, t.x AS tx, t.y AS ty, {phys_x} AS mx, {phys_y} AS my, p.x AS px, p.y AS py FROM scoring s
        JOIN outp t USING (game_id, play_id, nfl_id, frame_id) JOIN phys p ON p.id = s.id
        WHERE CAST(('0x' || substr(md5(concat_ws('_', s.game_id, s.play_id, '42')), 1, 8)) AS BIGINT) < {int(0.2 * 2 ** 32)}""")
    axis = {a: (f"(coalesce(0.3 * m{a}, 0) + coalesce(0.4 * {a}_input, 0) + 0.3 * {c}) / "
                f"(CASE WHEN m{a} IS NULL THEN 0 ELSE 0.3 END + CASE WHEN {a}_input IS NULL THEN 0 ELSE 0.4 END + 0.3)")
            for a, c in (("x", 50.0), ("y", 26.65))}
    compared = [("zero", "CAST(0 AS DOUBLE)", "CAST(0 AS DOUBLE)"), ("stationary", "x_input", "y_input"), ("physics", "px", "py"), ("blend", axis["x"], axis["y"])]
    q["model_comparison"] = build(st + [("phys", PHYS_SQL), model_rows], " UNION ALL ".join(
        f"SELECT '{m}' AS model, round(sqrt(0.5 * (avg((tx - {a}) ** 2) + avg((ty - {b}) ** 2))), 6) AS rmse, "
        f"round(sqrt(avg((tx - {a}) ** 2)), 6) AS rmse_x, round(sqrt(avg((ty - {b}) ** 2)), 6) AS rmse_y, count({a}) AS n FROM held" for m, a, b in compared))
    q["weekly_input_files"] = build(BASE_CTES, "SELECT * FROM inp")
    q["weekly_output_files"] = build(BASE_CTES, "SELECT * FROM outp WHERE week % 2 = 1")
    q["request_files"] = build(BASE_CTES + [
        ("per", "SELECT game_id, play_id, nfl_id, count(*) AS input_rows, max(frame_id) AS last_frame, max(x) AS max_x FROM inp GROUP BY ALL")],
        "SELECT id, t.game_id, t.play_id, t.nfl_id, t.frame_id, input_rows, last_frame, max_x FROM test_rows t LEFT JOIN per USING (game_id, play_id, nfl_id)")
    q["submission_files"] = build(st + [("phys", PHYS_SQL)], "SELECT id, round(x, 6) AS x, round(y, 6) AS y, round(x, 6) AS csv_x, round(y, 6) AS csv_y FROM phys")
    q["published_submission"] = build(st + [("phys", PHYS_SQL)], "SELECT id, round(x, 6) AS x, round(y, 6) AS y, count(*) OVER () AS recorded_rows, "
                                      "1::BIGINT AS good_runs, 1::BIGINT AS failed_runs FROM phys")
    odd = "(game_id * 10 + play_id + nfl_id + frame_id) % 50 = 0"
    q["quarantined_lines"] = build(BASE_CTES, f"SELECT week, count(*) FILTER (WHERE NOT ({odd})) AS rows_read, count(*) FILTER (WHERE {odd}) AS lines_aside FROM inp GROUP BY week")
    fold = "CAST(('0x' || substr(md5(concat_ws('_', game_id, play_id, '42', 'fold')), 1, 8)) AS BIGINT) % 5"
    q["fold_mean"] = build(st + [
        ("tf", f"SELECT {fold} AS fold, frame_id, x - x_input AS dx, y - y_input AS dy FROM samples"),
        ("mem", "SELECT m.member, frame_id, avg(dx) AS mdx, avg(dy) AS mdy FROM tf "
                "JOIN (SELECT unnest(range(0, 5)) AS member) m ON m.member <> tf.fold GROUP BY m.member, frame_id"),
        ("rq", "SELECT s.*, m.member FROM scoring s JOIN (SELECT unnest(range(0, 5)) AS member) m ON true")],
        "SELECT rq.id, rq.game_id, rq.play_id, round(avg(rq.x_input + mem.mdx), 6) AS x, "
        "round(avg(rq.y_input + mem.mdy), 6) AS y, count(mem.mdx) AS members "
        "FROM rq LEFT JOIN mem USING (member, frame_id) GROUP BY rq.id, rq.game_id, rq.play_id")
    ffin = ("ffin", f"SELECT {fold} AS fold, " + ", ".join(f"{_finite(c)} AS {c}" for c in FEATA_ALL) + " FROM fa")
    member = "(SELECT unnest(range(0, 5)) AS member) m"
    q["fold_scalers"] = build(st + [fa, ffin], " UNION ALL ".join(
        f"SELECT CAST(member AS INTEGER) AS fold, '{c}' AS feature, round(avg({c}), 6) AS mean, "
        f"round(CASE WHEN stddev_pop({c}) = 0 THEN 1.0 ELSE stddev_pop({c}) END, 6) AS scale, count(*) AS rows "
        f"FROM ffin JOIN {member} ON member <> fold GROUP BY member" for c in FEATA_ALL))
    reach = "coalesce(s_input * {f}(radians(dir_input)) * (0.1 * frame_id), 0.0) AS {c}"
    reach = ", ".join(reach.format(f=f, c=c) for f, c in (("cos", "u"), ("sin", "v")))
    solve = []
    for t in ("x", "y"):  # two scaled features: the normal equations' inverse by its determinant
        solve.append(f"((n + 1.0) * n * cu{t} / su - n * ruv * n * cv{t} / sv) / det AS wu{t}, ((n + 1.0) * n * cv{t} / sv - n * ruv * n * cu{t} / su) / det AS wv{t}")
    ridge = [("rt", f"SELECT {fold} AS fold, x - x_input AS dx, y - y_input AS dy, {reach} FROM samples WHERE x - x_input IS NOT NULL AND y - y_input IS NOT NULL"),
             ("rs", f"""SELECT member, count(*) AS n, avg(u) AS mu, avg(v) AS mv, avg(dx) AS mx, avg(dy) AS my, stddev_pop(u) AS su, stddev_pop(v) AS sv, corr(u, v) AS ruv,
                 covar_pop(u, dx) AS cux, covar_pop(u, dy) AS cuy, covar_pop(v, dx) AS cvx, covar_pop(v, dy) AS cvy FROM rt JOIN {member} ON member <> fold GROUP BY member"""),
             ("rd", "SELECT *, (n + 1.0) * (n + 1.0) - (n * ruv) * (n * ruv) AS det FROM rs"),
             ("rw", f"SELECT *, {', '.join(solve)} FROM rd")]
    fitted = {t: f"m{t} + wu{t} * (u - mu) / su + wv{t} * (v - mv) / sv" for t in ("x", "y")}
    q["fold_ridge"] = build(st + ridge + [("rq", f"SELECT id, game_id, play_id, x_input, y_input, {reach} FROM scoring")],
                            f"SELECT id, game_id, play_id, round(any_value(x_input) + avg({fitted['x']}), 6) AS x, round(any_value(y_input) + avg({fitted['y']}), 6) AS y "
                            "FROM rq LEFT JOIN rw ON true GROUP BY id, game_id, play_id")
    q["fold_errors"] = build(st + ridge, f"SELECT CAST(fold AS INTEGER) AS fold, round(sqrt(avg((dx - ({fitted['x']})) ** 2)), 6) AS rmse_x, "
                                         f"round(sqrt(avg((dy - ({fitted['y']})) ** 2)), 6) AS rmse_y, count(mx) AS n FROM rt LEFT JOIN rw ON member = fold GROUP BY fold")
    cuts = {"x_input": (10.0, 11), "y_input": (5.0, 10), "s_input": (1.0, 9), "a_input": (0.5, 11)}
    tried = " UNION ALL ".join(
        f"SELECT '{t}' AS target, {k} AS k, '{c}' AS feature, e AS threshold, count(*) FILTER (WHERE {c} <= e) AS nl, count(*) FILTER (WHERE {c} > e) AS nr, "
        f"sum({t} - m{t}) FILTER (WHERE {c} <= e) AS gl, sum({t} - m{t}) FILTER (WHERE {c} > e) AS gr, any_value(m{t}) AS base "
        f"FROM sr, (SELECT unnest(range(1, {n + 1})) * {w} AS e) GROUP BY e" for t in ("x", "y") for k, (c, (w, n)) in enumerate(cuts.items()))
    q["boosted_stump"] = build(st + [
        ("sr", "SELECT x, y, " + ", ".join(f"{_finite(c)} AS {c}" for c in cuts) + ", avg(x) OVER () AS mx, avg(y) OVER () AS my FROM samples"),
        ("tried", tried),
        ("gains", "SELECT *, gl * gl / nl + gr * gr / nr - (gl + gr) * (gl + gr) / (nl + nr) AS gain FROM tried WHERE nl >= 20 AND nr >= 20"),
        ("best", "SELECT *, row_number() OVER (PARTITION BY target ORDER BY gain DESC, k, threshold) AS place FROM gains")],
        "SELECT target, feature, CAST(threshold AS DOUBLE) AS threshold, round(gain / (nl + nr), 6) AS gain_per_row, round(base + 0.05 * gl / nl, 6) AS pred_left, "
        "round(base + 0.05 * gr / nr, 6) AS pred_right FROM best WHERE place = 1 AND gain > 0")
    ruled = "SELECT *, CAST('0x' || substr(md5(id), 1, 4) AS INTEGER) % 40 AS k FROM phys"
    planted = """SELECT CASE WHEN k = 5 AND n = 2 THEN id || '_x' ELSE id END AS id, game_id, play_id,
        CASE WHEN k = 3 THEN 'inf'::DOUBLE WHEN k <> 2 THEN x END AS x, CASE WHEN k = 4 THEN 'nan'::DOUBLE ELSE y END AS y
        FROM ruled, (VALUES (1), (2)) AS t(n) WHERE k <> 0 AND (n = 1 OR k IN (1, 5))"""
    q["validate_predictions"] = build(st + [("phys", PHYS_SQL), ("ruled", ruled), ("planted", planted)], """
        SELECT 'null_values' AS "check", count(*) FILTER (WHERE x IS NULL OR y IS NULL) AS violations FROM planted
        UNION ALL SELECT 'non_finite_values', count(*) FILTER (WHERE NOT isfinite(x) OR NOT isfinite(y)) FROM planted
        UNION ALL SELECT 'missing_ids', count(*) FROM phys WHERE id NOT IN (SELECT id FROM planted)
        UNION ALL SELECT 'extra_ids', count(DISTINCT id) FROM planted WHERE id NOT IN (SELECT id FROM phys)
        UNION ALL SELECT 'duplicate_ids', count(*) FROM (SELECT id FROM planted GROUP BY id HAVING count(*) > 1)
        UNION ALL SELECT 'plays_with_wrong_row_count', count(*) FROM
            (SELECT game_id, play_id, count(*) AS n FROM phys GROUP BY 1, 2) a FULL JOIN
            (SELECT game_id, play_id, count(*) AS n FROM planted GROUP BY 1, 2) b USING (game_id, play_id)
            WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)
        UNION ALL SELECT 'empty_request', CAST(count(*) = 0 AS BIGINT) FROM scoring""")
    ended = ["x", "y", "s", "a", "dir", "o", "player_role"]
    q["stream_ended_plays"] = build(BASE_CTES, "SELECT game_id, play_id, nfl_id, max(frame_id) AS frame_id, count(*) AS frames, "
                                    + ", ".join(f"arg_max({c}, frame_id) FILTER (WHERE {c} IS NOT NULL) AS {c}" for c in ended) + " FROM inp GROUP BY game_id, play_id, nfl_id")
    zero = " UNION ALL ".join(f"SELECT '{c}' AS \"check\", 0 AS violations" for c in
                              ("null_values", "non_finite_values", "missing_ids", "extra_ids", "duplicate_ids", "plays_with_wrong_row_count", "empty_request"))
    q["stream_repeated_ids"] = build(BASE_CTES, f"SELECT \"check\", CAST(violations AS BIGINT) AS violations FROM ({zero} UNION ALL SELECT 'ids_of_earlier_batches', "
                                                "count(*) FROM test_rows WHERE (game_id * 10 + play_id + nfl_id + frame_id) % 7 = 0)")
    k40 = "CAST('0x' || substr(md5(id), 1, 4) AS INTEGER) % 40"
    plays, short = "count(DISTINCT (game_id, play_id))", f"FROM phys WHERE {k40} = 0"
    faults = [("missing_id", "missing id column ''id''", "1", ""), ("missing_y", "value columns must be [''x'', ''y''], got [''x'']", "1", ""),
              ("extra_column", "value columns must be [''x'', ''y''], got [''x'', ''y'', ''z'']", "1", ""), ("text_x", "column ''x'' must be numeric", "1", ""),
              ("empty_prediction", "missing_ids", "count(*)", "FROM phys"), ("empty_prediction", "plays_with_wrong_row_count", plays, "FROM phys"),
              ("empty_request", "extra_ids", "count(*)", "FROM phys"), ("empty_request", "plays_with_wrong_row_count", plays, "FROM phys"),
              ("empty_request", "empty_request", "1", ""), ("no_play_key", "missing_ids", "count(*)", short), ("no_play_key", "plays_with_wrong_row_count", plays, short)]
    q["schema_faults"] = build(st + [("phys", PHYS_SQL), ("faults", " UNION ALL ".join(
        f"SELECT '{c}' AS \"case\", '{k}' AS \"check\", CAST({n} AS BIGINT) AS violations {src}" for c, k, n, src in faults))], "SELECT * FROM faults WHERE violations > 0")
    q["direction_faults"] = build(BASE_CTES, """SELECT 'direction_not_unique' AS "check", count(DISTINCT (game_id, play_id)) AS violations FROM inp WHERE (game_id * 10 + play_id) % 3 = 0
        UNION ALL SELECT 'direction_missing', count(*) FROM outp WHERE (game_id * 10 + play_id) % 4 = 0 OR (game_id, play_id) NOT IN (SELECT (game_id, play_id) FROM inp)""")
    held = f"CAST(('0x' || substr(md5(concat_ws('_', game_id, play_id, '42')), 1, 8)) AS BIGINT) < {int(0.2 * 2 ** 32)}"
    q["batches_of_plays"] = build(st + [("phys", PHYS_SQL)], f"SELECT id, game_id, play_id, CASE WHEN {held} THEN round(x, 6) ELSE 0.0 END AS x, "
                                                             f"CASE WHEN {held} THEN round(y, 6) ELSE 0.0 END AS y FROM phys WHERE (game_id, play_id) IN (SELECT (game_id, play_id) FROM inp)")
    groups = {"use_velocity": ["vx", "vy"], "use_distance": ["dist_to_ball_landing", "dist_from_los", "dist_to_near_sideline", "dist_from_center"],
              "use_angle": ["angle_to_ball", "pursuit_angle", "facing_ball", "body_alignment"]}
    q["feature_groups"] = build(st + [fa], " UNION ALL ".join(
        f"SELECT '{off}' AS off, '{c}' AS feature, round(avg(CAST({c} AS DOUBLE)), 6) AS mean FROM fa" for off, gone in groups.items() for c in FEATA_ALL if c not in gone))
    q["profile_counts"] = build(BASE_CTES, "SELECT count(DISTINCT game_id) AS games, "
                                           "count(DISTINCT (game_id, play_id)) AS plays, count(DISTINCT nfl_id) AS players, "
                                           "count(*) AS rows FROM inp")
    q["profile_per_play"] = build(BASE_CTES + [
        ("fl", "SELECT game_id, play_id, sum(CAST(player_to_predict AS INTEGER)) AS v FROM inp GROUP BY game_id, play_id"),
        ("fr", "SELECT game_id, play_id, nfl_id, count(*) AS v FROM outp GROUP BY game_id, play_id, nfl_id")],
        "SELECT 'flagged_rows_per_play' AS stat, round(avg(v), 6) AS mean, CAST(min(v) AS BIGINT) AS min, "
        "CAST(max(v) AS BIGINT) AS max, count(*) AS groups FROM fl UNION ALL "
        "SELECT 'frames_per_player_play', round(avg(v), 6), CAST(min(v) AS BIGINT), CAST(max(v) AS BIGINT), count(*) FROM fr")

    def vc(col: str, k: int | None) -> str:
        lim = f" WHERE rank <= {k}" if k else ""
        return (f"SELECT * FROM (SELECT '{col}' AS \"column\", CAST({col} AS VARCHAR) AS value, count(*) AS n, "
                f"CAST(row_number() OVER (ORDER BY count(*) DESC, {col} ASC NULLS LAST) AS INTEGER) AS rank "
                f"FROM inp GROUP BY {col}){lim}")
    q["value_counts_topk"] = build(BASE_CTES, " UNION ALL ".join(
        [vc("player_position", 10), vc("player_side", None), vc("player_role", None)]))
    err = [("phys", PHYS_SQL),
           ("err", "SELECT p.x - o.x AS error_x, p.y - o.y AS error_y, "
                   "sqrt((p.x - o.x) ** 2 + (p.y - o.y) ** 2) AS error_dist FROM phys p "
                   "JOIN (SELECT concat_ws('_', game_id, play_id, nfl_id, frame_id) AS id, x, y FROM outp) o USING (id)")]
    q["error_stats"] = build(st + err, " UNION ALL ".join(
        f"SELECT '{c}' AS error, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std, count({c}) AS n FROM err"
        for c in ("error_x", "error_y", "error_dist")))
    q["error_histogram"] = build(st + err + [
        ("rng", "SELECT CASE WHEN min(error_dist) = max(error_dist) THEN min(error_dist) - 0.5 ELSE min(error_dist) END AS lo, "
                "CASE WHEN min(error_dist) = max(error_dist) THEN max(error_dist) + 0.5 ELSE max(error_dist) END AS hi FROM err"),
        ("b", "SELECT CAST(least(CAST(floor((error_dist - lo) / ((hi - lo) / 50)) AS INTEGER) + 1, 50) AS INTEGER) AS bin, lo, hi "
              "FROM err, rng WHERE error_dist IS NOT NULL")],
        "SELECT bin, round(lo + (bin - 1) * ((hi - lo) / 50), 6) AS bin_lo, round(lo + bin * ((hi - lo) / 50), 6) AS bin_hi, "
        "count(*) AS n FROM b GROUP BY bin, lo, hi")
