"""Word rules of the published lexicon scorer (Hutto and Gilbert, 2014) as column expressions."""

from __future__ import annotations

from functools import reduce
from itertools import chain
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the published rule model -------------------------------------------------------
# They are part of a model published under the MIT licence, Copyright (c) 2016 C.J. Hutto. Permission is granted,
# free of charge, to use, copy, modify and distribute it provided that this notice is included; it is provided
# "as is", without warranty of any kind.

DEGREE_STEP = 0.293
CAPITALS_STEP = 0.733
NEGATION_FACTOR = -0.74
NEVER_SO_FACTOR = 1.25
DISTANCE_DAMPING = {1: 1.0, 2: 0.95, 3: 0.9}
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAMATION_STEP, EXCLAMATION_MAX = 0.292, 4
QUESTION_STEP, QUESTION_STEPS_MAX, QUESTION_CEILING = 0.18, 3, 0.96

NEGATORS = (
    "aint arent cannot cant couldnt darent didnt doesnt ain't aren't can't couldn't daren't didn't doesn't "
    "dont hadnt hasnt havent isnt mightnt mustnt neither don't hadn't hasn't haven't isn't mightn't mustn't "
    "neednt needn't never none nope nor not nothing nowhere oughtnt shant shouldnt uhuh wasnt werent oughtn't "
    "shan't shouldn't uh-uh wasn't weren't without wont wouldnt won't wouldn't rarely seldom despite"
).split()

STRENGTHENERS = (
    "absolutely amazingly awfully completely considerable considerably decidedly deeply effing enormous "
    "enormously entirely especially exceptional exceptionally extreme extremely fabulously flipping flippin "
    "frackin fracking fricking frickin frigging friggin fully fuckin fucking fuggin fugging greatly hella highly "
    "hugely incredible incredibly intensely major majorly more most particularly purely quite really remarkably "
    "so substantially thoroughly total totally tremendous tremendously uber unbelievably unusually utter utterly "
    "very"
).split()

WEAKENERS = (
    "almost barely hardly kinda kindof kind-of less little marginal marginally occasional occasionally partly "
    "scarce scarcely slight slightly somewhat sorta sortof sort-of"
).split()
WEAKENING_PHRASES = ("just enough", "kind of", "sort of")

IDIOMS = {
    "the shit": 3.0,
    "the bomb": 3.0,
    "bad ass": 1.5,
    "badass": 1.5,
    "bus stop": 0.0,
    "yeah right": -2.0,
    "kiss of death": -1.5,
    "to die for": 3.0,
    "beating heart": 3.1,
    "broken heart": -2.9,
}

# ------------------------------------------------------------------------------------------------


def is_upper(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word))


def modifier_words(spark: SparkSession) -> DataFrame:
    """Degree words and negators as a table ``(word, degree, negates)``."""
    degrees = dict.fromkeys(STRENGTHENERS, DEGREE_STEP) | dict.fromkeys(WEAKENERS, -DEGREE_STEP)
    words = sorted({*degrees, *NEGATORS})
    rows = [(w, degrees.get(w, 0.0), w in NEGATORS) for w in words]
    return spark.createDataFrame(rows, "word string, degree double, negates boolean")


def shifted(value: Column, degree_before: Column, capitals_before: Column, distance: int) -> Column:
    """Valence after a degree word ``distance`` places before it, written in capitals or not."""
    strength = F.when(value < 0, -degree_before).otherwise(degree_before)
    louder = F.when(value > 0, capitals_before).otherwise(-capitals_before)
    return value + (strength + louder) * DISTANCE_DAMPING[distance]


def capitals(word: Column, mixed: Column) -> Column:
    """Extra strength of a word in capitals among words that are not; 0 otherwise."""
    return F.when(mixed & is_upper(word), CAPITALS_STEP).otherwise(0.0)


def negation_factor(word: Column, listed: Column) -> Column:
    """Factor of a word before a hit; ``listed`` says whether it is a listed negator."""
    return F.when(listed | word.contains("n't"), NEGATION_FACTOR).otherwise(1.0)


def contextual_negation_factor(before: dict[int, Column], listed: Column, distance: int) -> Column:
    """Factor of the word at ``distance``; "never so" strengthens, "without doubt" changes nothing."""
    plain = negation_factor(before[distance], listed)
    nearer = [before[d] for d in range(1, distance)]
    if not nearer:
        return plain
    so = reduce(or_, [F.coalesce(w.isin("so", "this"), F.lit(False)) for w in nearer])
    doubt = reduce(or_, [w.eqNullSafe(F.lit("doubt")) for w in nearer])
    return (
        F.when((before[distance] == "never") & so, NEVER_SO_FACTOR)
        .when((before[distance] == "without") & doubt, 1.0)
        .otherwise(plain)
    )


def joined(*words: Column | str) -> Column:
    """The words joined by blanks; null when one is missing."""
    return reduce(lambda a, b: F.concat(a, F.lit(" "), b), [F.col(w) if isinstance(w, str) else w for w in words])


#: Phrases around a word, by the names of their words; later ones build on earlier ones.
PAIRS = {"_p32": ("_b3", "_b2"), "_p21": ("_b2", "_b1"), "_p1t": ("_b1", "term"), "_pt1": ("term", "_a1")}
TRIPLES = {"_p321": ("_b3", "_p21"), "_p21t": ("_p21", "term"), "_pt12": ("_pt1", "_a2")}


def idiom_value() -> Column:
    """Valence of an idiom the word is part of or stands behind; null when there is none."""
    values = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in IDIOMS.items()))
    places = F.array("_pt12", "_pt1", "_p1t", "_p21t", "_p21", "_p321", "_p32")
    found = F.transform(F.array_compact(places), lambda p: F.try_element_at(values, p))
    return F.get(F.array_compact(found), F.lit(0))


def weakening() -> Column:
    """What weakening phrases of several words before the word take off its valence."""
    weak = F.array(*map(F.lit, WEAKENING_PHRASES))
    count = F.size(F.filter(F.array("_p321", "_p32", "_p21"), lambda p: F.array_contains(weak, p)))
    return count * DEGREE_STEP


def punctuation_emphasis(text: Column) -> Column:
    """Strength added by exclamation and question marks."""
    exclamations = F.regexp_count(text, F.lit("!"))
    questions = F.regexp_count(text, F.lit(r"\?"))
    asked = (
        F.when(questions <= 1, F.lit(0.0))
        .when(questions <= QUESTION_STEPS_MAX, questions * QUESTION_STEP)
        .otherwise(F.lit(QUESTION_CEILING))
    )
    return F.least(exclamations, F.lit(EXCLAMATION_MAX)) * EXCLAMATION_STEP + asked


def with_emphasis(total: Column, emphasis: Column) -> Column:
    return F.when(total > 0, total + emphasis).when(total < 0, total - emphasis).otherwise(total)
