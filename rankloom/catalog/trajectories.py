"""Returns, advantages, sampled rankings and training-log scans."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankloom.catalog.fixtures import (
    CHOICES, EPOCHS, TRAJ, choices, epoch_log, hash_sql, traj, uniform_sql)
from rankloom.catalog.registry import query
from rankloom.functions.scalars import linear_decay
from rankloom.operators import trajectory as T
from rankloom.operators.ordering import grouped_rank, score_order

G = 0.95
_SUFFIX = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def suffix(value: str, gamma: float, by: str = "g") -> str:
    return (f"sum(({value}) * pow({gamma}, step)) OVER (PARTITION BY {by} ORDER BY step DESC {_SUFFIX})"
            f" / pow({gamma}, step)")


@query("win_02_discounted_returns", f"WITH {TRAJ} SELECT g, step, {suffix('reward', G)} AS q FROM traj",
       dbl="q", num="g step")
def _(t):
    return T.discounted_returns(traj(t), G).select("g", "step", "q")


@query("win_02_undiscounted_returns", f"WITH {TRAJ} SELECT g, step, {suffix('reward', 1.0)} AS q FROM traj",
       dbl="q", num="g step")
def _(t):
    return T.discounted_returns(traj(t), 1.0).select("g", "step", "q")


@query("win_03_centred_returns", f"""WITH {TRAJ}, r AS (SELECT g, step, {suffix('reward', G)} AS q FROM traj)
  SELECT g, step, q - avg(q) OVER (PARTITION BY g) AS q_centred FROM r""", dbl="q_centred", num="g step")
def _(t):
    return T.centred_returns(traj(t), G).select("g", "step", "q_centred")


_DELTA = f"""{TRAJ}, d AS (SELECT *, lead(value) OVER (PARTITION BY g ORDER BY step) AS nv FROM traj),
  e AS (SELECT *, CASE WHEN nv IS NULL THEN reward ELSE reward + {G} * nv - value END AS delta FROM d)"""


@query("win_04_gae", f"""WITH {_DELTA}, a AS (SELECT *, {suffix('delta', G * 0.9)} AS advantage FROM e)
  SELECT g, step, advantage, advantage + value AS ret FROM a""", dbl="advantage ret", num="g step")
def _(t):
    return T.gae(traj(t), G, 0.9).select("g", "step", "advantage", "ret")


@query("win_05_gae_masked_last", f"""WITH {TRAJ}, d AS (SELECT *, lead(value) OVER (PARTITION BY g ORDER BY step) AS nv
  FROM traj), e AS (SELECT *, CASE WHEN step = n - 1 THEN reward WHEN step = n - 2 THEN reward - value
  ELSE reward + {G} * nv - value END AS delta FROM d),
  a AS (SELECT *, {suffix('CASE WHEN step = n - 1 THEN 0 ELSE delta END', G * 0.9)} AS carried FROM e),
  b AS (SELECT *, CASE WHEN step = n - 1 THEN delta ELSE carried END AS advantage FROM a)
  SELECT g, step, advantage, advantage + value AS ret FROM b""", dbl="advantage ret", num="g step")
def _(t):
    return T.gae(traj(t), G, 0.9, mask_last=True).select("g", "step", "advantage", "ret")


@query("win_05_returns_masked_last", f"""WITH {TRAJ}, a AS (SELECT *,
  {suffix('CASE WHEN step = n - 1 THEN 0 ELSE reward END', G)} AS q FROM traj)
  SELECT g, step, CASE WHEN step = n - 1 THEN reward ELSE q END AS ret FROM a""", dbl="ret", num="g step")
def _(t):
    return T.gae(traj(t), G, 0.9, mask_last=True, use_gae=False).select("g", "step", "ret")


@query("win_06_gae_terminal_reward", f"""WITH {_DELTA}, a AS (SELECT *,
  {suffix('CASE WHEN step = n - 1 THEN 0 ELSE delta END', G * 0.9)} AS carried FROM e)
  SELECT g, step, CASE WHEN step = n - 1 THEN reward ELSE carried + value END AS ret FROM a""",
       dbl="ret", num="g step")
def _(t):
    return T.gae(traj(t), G, 0.9, terminal="reward").select("g", "step", "ret")


@query("win_07_normalised_advantage", f"""WITH {_DELTA}, a AS (SELECT *, {suffix('delta', G * 0.9)} AS adv FROM e)
  SELECT g, step, (adv - avg(adv) OVER ()) / (stddev_samp(adv) OVER () + 1e-5) AS advantage FROM a""",
       dbl="advantage", num="g step")
def _(t):
    return T.normalise_advantage(T.gae(traj(t), G, 0.9)).select("g", "step", "advantage")


_SAMPLED = f"""{CHOICES}, noisy AS (SELECT g, i, s, draw, s - ln(-ln({uniform_sql(7, 'draw', 'g', 'i')})) AS k
  FROM choices, range(3) d(draw)), sampled AS (SELECT *,
  row_number() OVER (PARTITION BY g, draw ORDER BY k DESC, i) - 1 AS step FROM noisy)"""


def _sampled(t):
    return T.sample_rankings(choices(t), 3, 7, label=None)


@query("win_08_sample_rankings", f"WITH {_SAMPLED} SELECT g, draw, i, step FROM sampled", num="g draw step")
def _(t):
    return _sampled(t).select("g", "draw", "i", "step")


_Z = f"""{_SAMPLED}, m AS (SELECT *, max(s) OVER (PARTITION BY g, draw) AS top FROM sampled),
  z AS (SELECT *, sum(exp(s - top)) OVER w AS e, sum(exp(s - top) * s) OVER w AS es FROM m
  WINDOW w AS (PARTITION BY g, draw ORDER BY step DESC {_SUFFIX}))"""


@query("win_09_log_prob", f"WITH {_Z} SELECT g, draw, step, s - top - ln(e) AS log_prob FROM z",
       dbl="log_prob", num="g draw step")
def _(t):
    return T.ranking_log_prob(_sampled(t), ["g", "draw"]).select("g", "draw", "step", "log_prob")


@query("win_10_entropy_stat", f"WITH {_Z} SELECT step, avg(-es / e) AS entropy FROM z GROUP BY step",
       dbl="entropy", num="step")
def _(t):
    return T.entropy_stat(_sampled(t), "ref", ["g", "draw"])


@query("win_10_entropy_shannon", f"WITH {_Z} SELECT step, avg(top + ln(e) - es / e) AS entropy FROM z GROUP BY step",
       dbl="entropy", num="step")
def _(t):
    return T.entropy_stat(_sampled(t), "shannon", ["g", "draw"])


@query("win_11_remaining", f"""WITH {_SAMPLED} SELECT g, draw, i, 0 AS open_from, step AS open_until,
  count(*) OVER (PARTITION BY g, draw) - step AS candidates FROM sampled""",
       num="g draw open_from open_until candidates")
def _(t):
    return T.remaining(_sampled(t), ["g", "draw"]).select(
        "g", "draw", "i", "open_from", "open_until", "candidates")


@query("win_12_segments", f"WITH {TRAJ} SELECT g, step, n AS length, step = n - 1 AS is_last FROM traj",
       num="g step length")
def _(t):
    return T.segments(traj(t)).select("g", "step", "length", "is_last")


_PPO = f"""{_DELTA}, a AS (SELECT g, step, value, ln(1 + reward) AS lp0, ln(1 + reward) + (step % 7 - 3) * 0.1 AS lp1,
  value * (1 + (step % 5 - 2) * 0.2) AS v1, reward AS entropy, {suffix('delta', G * 0.9)} AS adv FROM e),
  b AS (SELECT *, exp(lp1 - lp0) AS ratio, adv + value AS ret FROM a),
  c AS (SELECT *, value + least(greatest(v1 - value, -0.2), 0.2) AS kept FROM b),
  f AS (SELECT avg(ratio) AS mean_ratio,
  -avg(least(ratio * adv, least(greatest(ratio, 0.8), 1.2) * adv)) AS action_loss,
  avg(0.5 * greatest((v1 - ret) * (v1 - ret), (kept - ret) * (kept - ret))) AS value_loss,
  avg(entropy) AS entropy,
  avg(CASE WHEN ratio < 0.8 OR ratio > 1.2 THEN 1.0 ELSE 0.0 END) AS clip_share FROM c)"""


@query("win_13_surrogate_stats", f"WITH {_PPO} SELECT *, action_loss + 0.5 * value_loss - 0.01 * entropy AS total_loss FROM f",
       dbl="mean_ratio action_loss value_loss entropy clip_share total_loss")
def _(t):
    path = T.gae(traj(t), G, 0.9)
    lp = F.log(F.lit(1.0) + F.col("reward"))
    old = path.withColumn("log_prob", lp)
    new = path.select("g", "step", (lp + (F.col("step") % 7 - 3) * 0.1).alias("log_prob"),
                      (F.col("value") * (1 + (F.col("step") % 5 - 2) * 0.2)).alias("value"),
                      F.col("reward").alias("entropy"))
    return T.surrogate_stats(old, new, 0.2, 0.5, 0.01)


@query("win_14_minibatches", f"""WITH r AS (SELECT event_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY {hash_sql(11, 'event_id')}, event_id) AS rn FROM events)
  SELECT event_id, (rn - 1) // (n // 7) AS batch FROM r WHERE ((rn - 1) // (n // 7) + 1) * (n // 7) <= n""",
       num="event_id batch")
def _(t):
    return T.minibatches(t.events.select("event_id"), 7, "event_id", 11)


_STOP = f"""{EPOCHS}, b AS (SELECT *, max(test_ndcg) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  AS prev FROM epochs), c AS (SELECT *, prev IS NULL OR test_ndcg > prev AS is_best, greatest(test_ndcg, prev) AS best
  FROM b), d AS (SELECT *, epoch - max(CASE WHEN is_best THEN epoch END) OVER (ORDER BY epoch) AS waited FROM c),
  e AS (SELECT *, coalesce(sum(CASE WHEN waited >= 20 THEN 1 ELSE 0 END) OVER (ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS hits FROM d)"""


@query("win_15_early_stop", f"WITH {_STOP} SELECT epoch, best, is_best, waited FROM e WHERE hits = 0",
       dbl="best", num="epoch waited")
def _(t):
    return T.early_stop(epoch_log(t), 20).select("epoch", "best", "is_best", "waited")


@query("win_16_running_average", f"""WITH {EPOCHS} SELECT epoch, sum(test_ndcg * n) OVER (ORDER BY epoch)
  / sum(n) OVER (ORDER BY epoch) AS avg FROM epochs""", dbl="avg", num="epoch")
def _(t):
    return T.running_average(epoch_log(t), "test_ndcg", "n", "epoch").select("epoch", "avg")


@query("scl_18_linear_decay", f"""WITH {EPOCHS} SELECT epoch, 0.01 * (1 - epoch / (SELECT count(*) FROM epochs)::DOUBLE) * 1000
  AS lr FROM epochs""", dbl="lr", num="epoch")
def _(t):
    log = epoch_log(t)
    total = log.agg(F.count("*")).scalar()
    return log.select("epoch", (linear_decay(0.01, "epoch", total) * 1000).alias("lr"))
