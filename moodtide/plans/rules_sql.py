"""SQL of the rule scorer and of the small classifier, given CTEs ``texts(source, id, text)`` and ``lexicon(term, polarity)``."""

from __future__ import annotations

from moodtide.functions import valence

WORDS = r"""[t for t in string_split_regex({text}, '[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+') if t <> '']"""
BARE = """case when length(trim({t}, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~')) <= 2 then {t}
          else trim({t}, '!"#$%&''()*+,-./:;<=>?@[\\]^_`{{|}}~') end"""


def quoted(words: object) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


STEP = valence.DEGREE_STEP
#: Every word with its neighbours: the last CTE is ``context``.
CONTEXT_CTE = f"""split as (
      select source, id, text, generate_subscripts(ws, 1) as pos, unnest(ws) as t
      from (select *, {WORDS.format(text="text")} as ws from texts)),
    bare as (select source, id, text, pos, {BARE.format(t="t")} as w from split),
    flagged as (
      select *, lower(w) as lw, coalesce(w = upper(w) and w <> lower(w), false) as up,
             case when lower(w) in {quoted(valence.STRENGTHENERS)} then {STEP}
                  when lower(w) in {quoted(valence.WEAKENERS)} then -{STEP} else 0 end as deg,
             lower(w) in {quoted(valence.NEGATORS)} or contains(lower(w), 'n''t') as neg
      from bare),
    looked as (select f.*, polarity, polarity is not null as known from flagged f left join lexicon on term = lw),
    context as (
      select *,
             {", ".join(f"lag({c}, {d}) over w as {c}{d}" for c in ("lw", "up", "deg", "neg", "known") for d in (1, 2, 3))},
             lead(lw) over w as next1, lead(lw, 2) over w as next2, lead(known) over w as next_known,
             count(*) filter (up) over (partition by source, id) as ups,
             count(*) over (partition by source, id) as n,
             min(pos) filter (lw = 'but') over (partition by source, id) as turn
      from looked window w as (partition by source, id order by pos))"""


def _ruled_step(value: str, d: int) -> str:
    caps = f"case when deg{d} <> 0 and up{d} and mixed then {valence.CAPITALS_STEP} else 0 end"
    moved = (
        f"({value} + (case when {value} < 0 then -deg{d} else deg{d} end + "
        f"case when {value} > 0 then {caps} else -({caps}) end) * {valence.DISTANCE_DAMPING[d]})"
    )
    negated = f"case when neg{d} then {valence.NEGATION_FACTOR} else 1 end"
    near = [f"lw{k}" for k in range(1, d)]
    if near:
        so = " or ".join(f"coalesce({w} in ('so', 'this'), false)" for w in near)
        doubt = " or ".join(f"coalesce({w} = 'doubt', false)" for w in near)
        negated = (
            f"case when lw{d} = 'never' and ({so}) then {valence.NEVER_SO_FACTOR} "
            f"when lw{d} = 'without' and ({doubt}) then 1 else {negated} end"
        )
    return f"case when not known{d} then {moved} * {negated} else {value} end"


IDIOM_MAP = "map {" + ", ".join(f"'{k}': {v}::double" for k, v in valence.IDIOMS.items()) + "}"
IDIOM_PLACES = (
    "lw || ' ' || next1 || ' ' || next2", "lw || ' ' || next1", "lw1 || ' ' || lw", "lw2 || ' ' || lw1 || ' ' || lw",
    "lw2 || ' ' || lw1", "lw3 || ' ' || lw2 || ' ' || lw1", "lw3 || ' ' || lw2",
)
WEAK_PLACES = ("lw3 || ' ' || lw2 || ' ' || lw1", "lw3 || ' ' || lw2", "lw2 || ' ' || lw1")

#: From ``context`` to ``totals(source, id, s)`` by all rules.
TOTALS_CTE = f"""mixed as (select *, ups > 0 and ups < n as mixed from context where known),
    stated as (
      select *, case when lw1 = 'no' or lw2 = 'no' or (lw3 = 'no' and lw1 in ('or', 'nor')) then polarity * {valence.NEGATION_FACTOR}
                     when lw = 'no' and next_known then 0.0 else polarity end as p from mixed),
    v0 as (select *, p + case when up and mixed then case when p > 0 then {valence.CAPITALS_STEP} else -{valence.CAPITALS_STEP} end
                    else 0 end as v from stated),
    v1 as (select * exclude v, {_ruled_step("v", 1)} as v from v0),
    v2 as (select * exclude v, {_ruled_step("v", 2)} as v from v1),
    v3 as (select * exclude v, {_ruled_step("v", 3)} as v from v2),
    settled as (
      select *, case when not known3 then
          coalesce({", ".join(f"{IDIOM_MAP}[{p}]" for p in IDIOM_PLACES)}, v)
          - {" - ".join(f"case when {p} in {quoted(valence.WEAKENING_PHRASES)} then {STEP} else 0 end" for p in WEAK_PLACES)}
        else v end as s from v3),
    final as (
      select source, id, s
        * case when lw1 = 'least' and not known1 and not coalesce(lw2 in ('at', 'very'), false) then {valence.NEGATION_FACTOR} else 1 end
        * case when deg <> 0 or (lw = 'kind' and coalesce(next1 = 'of', false)) then 0
               when pos < turn then {valence.BEFORE_BUT} when pos > turn then {valence.AFTER_BUT} else 1 end as s
      from settled),
    sums as (select source, id, sum(s) as s from final group by source, id),
    marks as (
      select source, id, least(length(text) - length(replace(text, '!', '')), 4) * {valence.EXCLAMATION_STEP} as ep,
             length(text) - length(replace(text, '?', '')) as q from texts),
    emphasis as (
      select source, id, ep + case when q <= 1 then 0 when q <= 3 then q * {valence.QUESTION_STEP} else {valence.QUESTION_CEILING} end as e
      from marks),
    totals as (
      select t.source, t.id, case when s > 0 then s + e when s < 0 then s - e else 0.0 end as s
      from texts t left join sums using (source, id) join emphasis using (source, id))"""

#: What the small predictor reads of a text.
FIRST_TOKENS = r"""list_slice([t for t in string_split_regex(lower(text), '[ \t\n\x0B\f\r]+') if t <> ''], 1, 500)"""
WORDS_OF = r"""[t for t in string_split_regex(lower(coalesce({text}, '')), '[^\p{{L}}\p{{N}}'']+') if t <> '']"""

#: The word classifier, trained on all labelled documents: words of five of them at least, naive Bayes with one added to each count.
TRAINED_CTE = f"""labelled_words as (
      select doc_id, quality, unnest({WORDS_OF.format(text="text")}) as w from documents join labels using (doc_id)),
    word_facts as (
      select w, count(*) filter (quality = 1) as good, count(*) filter (quality = 0) as poor from labelled_words
      group by w having count(distinct doc_id) >= 5),
    class_facts as (
      select ln(sum(poor) + count(*)) - ln(sum(good) + count(*)) as shift,
             (select ln(count(*) filter (quality = 1) + 1) - ln(count(*) filter (quality = 0) + 1) from documents join labels using (doc_id)) as prior
      from word_facts),
    word_weights as (select w, ln(good + 1) - ln(poor + 1) + shift as weight from word_facts, class_facts)"""


def classifier_cte(rows: str) -> str:
    """CTE ``classified(source, id, p)``: the trained word classifier over ``rows(source, id, text)``."""
    return f"""{TRAINED_CTE},
    words_of as (select source, id, unnest({WORDS_OF.format(text="text")}) as w from {rows}),
    logits as (select source, id, sum(weight) as z from words_of join word_weights using (w) group by source, id),
    classified as (
      select r.source, r.id, 1 / (1 + exp(-(coalesce(z, 0.0) + prior))) as p
      from {rows} r left join logits using (source, id), class_facts)"""
