"""SQL that states the series operators by their definition: weighted sums over all earlier rows."""

from moodtide.plans.fixtures import PRICES_CTE


def mean(value: str, alpha: str) -> str:
    """Exponential mean of ``b.<value>`` at row ``a.i``, over rows ``b`` up to it."""
    weight = f"pow(1.0::double - {alpha}, a.i - b.i)"
    return f"sum(b.{value} * {weight}) / nullif(sum(case when b.{value} is not null then {weight} end), 0)"


INDICATED_CTE = f"""{PRICES_CTE},
    placed as (select *, row_number() over (order by date) - 1 as i from prices),
    levels as (
      select a.i, {mean("close", "2.0/10")} as ema, {mean("close", "2.0/13")} - {mean("close", "2.0/27")} as macd
      from placed a join placed b on b.i <= a.i group by a.i),
    moves as (
      select p.*, ema, macd, greatest(close - lag(close) over (order by p.i), 0) as gain,
             greatest(lag(close) over (order by p.i) - close, 0) as loss
      from placed p join levels using (i)),
    marked as (
      select i, case when i > 0 then gain end as gain, case when i > 0 then loss end as loss, macd from moves),
    changes as (
      select a.i, {mean("macd", "2.0/10")} as signal, {mean("gain", "1.0/14")} as up, {mean("loss", "1.0/14")} as down
      from marked a join marked b on b.i <= a.i group by a.i),
    indicated as (
      select series_id, date, open, high, low, close, volume, macd, signal, ema,
             case when down > 0 then 100 - 100 / (1 + up / down) when up > 0 then 100.0 end as rsi, i
      from moves join changes using (i))"""

SPLIT_CTE = """splits as (
      select *, case when row_number() over (partition by source order by date desc) <= 60 then 'test' else 'train' end as split
      from (select series_id as source, date, close, high, volume from prices) p)"""
