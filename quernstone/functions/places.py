"""Populations of places, and what a variable's name says about an epidemic model."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import plain_words

#: Population by name of a place.
POPULATION: dict[str, int] = {
    "world": 8_000_000_000, "global": 8_000_000_000, "worldwide": 8_000_000_000, "monde": 8_000_000_000,
    "europe": 745_000_000, "european union": 449_000_000, "eu": 449_000_000, "ue": 449_000_000,
    "africa": 1_400_000_000, "afrique": 1_400_000_000, "asia": 4_700_000_000, "asie": 4_700_000_000,
    "north america": 600_000_000, "south america": 435_000_000, "latin america": 660_000_000,
    "oceania": 45_000_000, "middle east": 380_000_000,
    "france": 68_000_000, "switzerland": 8_800_000, "suisse": 8_800_000,
    "united states": 335_000_000, "united states of america": 335_000_000, "usa": 335_000_000, "u.s.": 335_000_000,
    "united kingdom": 67_000_000, "uk": 67_000_000, "england": 56_000_000, "royaume-uni": 67_000_000,
    "germany": 84_000_000, "allemagne": 84_000_000, "italy": 59_000_000, "italie": 59_000_000,
    "spain": 48_000_000, "espagne": 48_000_000, "canada": 40_000_000, "china": 1_410_000_000, "chine": 1_410_000_000,
    "india": 1_430_000_000, "inde": 1_430_000_000, "brazil": 215_000_000, "brésil": 215_000_000,
    "japan": 124_000_000, "japon": 124_000_000, "australia": 26_000_000, "australie": 26_000_000,
    "netherlands": 17_700_000, "pays-bas": 17_700_000, "belgium": 11_700_000, "belgique": 11_700_000,
    "sweden": 10_500_000, "norway": 5_500_000, "denmark": 5_900_000, "austria": 9_100_000, "autriche": 9_100_000,
    "portugal": 10_300_000, "greece": 10_400_000, "poland": 37_700_000, "ireland": 5_100_000, "irlande": 5_100_000,
    "geneva": 500_000, "geneve": 500_000, "genève": 500_000, "grand geneve": 1_050_000, "grand genève": 1_050_000,
    "vaud": 815_000, "lausanne": 815_000, "valais": 350_000, "sion": 350_000,
    "neuchatel": 175_000, "neuchâtel": 175_000, "fribourg": 325_000, "jura": 73_000,
    "romandie": 2_000_000, "suisse romande": 2_000_000, "swiss romande": 2_000_000,
    "french-speaking switzerland": 2_000_000, "lake geneva region": 1_100_000,
    "leman": 1_100_000, "léman": 1_100_000,
}

#: Words that name a series of the epidemic model, the first match counts.
SERIES_WORDS: dict[str, tuple[str, ...]] = {
    "seir_deaths": ("death", "deaths", "deces", "mortalit", "fatalit", "fatal", "cumulative death", "number of deaths"),
    "seir_recovered": ("recovered", "recovery", "removed", "immune", "immunis", "immunity", "immunite", "gueri", "retabli", "convalescent", "seroconvert"),
    "seir_exposed": ("exposed", "expose", "latent", "latently", "incubating", "presymptomatic", "presymptomatique", "pre symptomatic"),
    "seir_susceptible": ("susceptible", "susceptibles", "at risk population", "population a risque", "non immun", "non immunise"),
    "seir_cumulative": (
        "cumulative", "cumul", "cumule", "attack rate", "taux d attaque", "total case", "total cases", "total infection", "total infections",
        "cas totaux", "infections totales", "final size", "taille finale", "ever infected", "deja infecte",
    ),
    "seir_incidence": (
        "incidence", "incident", "new case", "new cases", "new infection", "new infections", "nouveaux cas", "nouvelle infection",
        "nouvelles infections", "daily case", "daily cases", "daily infection", "cas quotidien", "cas journalier", "reported case", "confirmed case",
        "notified case", "cas confirme", "cas notifie", "cas declare", "cas rapporte", "infection rate", "taux d infection", "taux d incidence",
        "notification rate",
    ),
    "seir_prevalence": (
        "prevalence", "prevalent", "active case", "active cases", "cas actif", "infectious", "infectieux", "currently infected",
        "actuellement infecte", "infected individual", "infected population", "personnes infectees", "nombre d infecte", "symptomatic case",
        "cas symptomatique", "active infection", "en cours d infection",
    ),
}
#: Whole words and parts of names that mean a parameter of the model.
PARAMETER_WORDS = ("r0", "rt", "reff", "cfr", "ifr")
PARAMETER_PARTS = (
    "reproduction", "reproductif", "reproductive", "transmission rate", "transmission coefficient", "taux de transmission", "contact rate",
    "taux de contact", "case fatality", "infection fatality", "fatality rate", "letalite", "recovery rate", "taux de guerison", "removal rate",
    "incubation", "latent period", "periode de latence", "infectious period", "periode infectieuse", "periode de contagiosite",
    "duree de contagiosite", "serial interval", "intervalle seriel", "generation time", "generation interval", "temps de generation",
    "intervalle de generation", "immunity duration", "duree d immunite", "duree de l immunite", "waning", "immunite decroissante",
)


def population(label: Column) -> Column:
    """Population of a place's name, or else of the first part of it (between commas, slashes, semicolons or bars) that is known."""
    known = F.create_map(*[F.lit(x) for k, v in POPULATION.items() for x in (k, float(v))])
    whole = F.lower(F.trim(label))
    parts = F.concat(F.array(whole), F.transform(F.split(F.regexp_replace(whole, "[/;|]", ","), ","), lambda x: F.trim(x)))
    return F.get(F.filter(F.transform(parts, lambda p: F.try_element_at(known, p)), lambda v: v.isNotNull()), F.lit(0))


def population_in(text: Column) -> Column:
    """(population, label) of the least populous place that a text names in whole words; the first listed, if equal; null without one."""
    padded = F.concat(F.lit(" "), plain_words(text), F.lit(" "))
    found = []
    for i, (label, people) in enumerate(POPULATION.items()):
        word = "".join(c if c.isalnum() else " " for c in _ascii(label).lower())
        place = F.struct(F.lit(float(people)).alias("population"), F.lit(i).alias("place"), F.lit(label).alias("label"))
        found.append(F.when(F.contains(padded, F.lit(f" {' '.join(word.split())} ")), place))
    best = F.array_min(F.array(*found))
    return F.when(best.isNotNull(), F.struct(best["population"].alias("population"), best["label"].alias("label")))


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


def _holds(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, w: a | F.contains(text, F.lit(w)), words, F.lit(False))


def series_column(name: Column) -> Column:
    """The series of the model that a variable's name means; null without one."""
    t = plain_words(name)
    out = F.lit(None).cast("string")
    for column, words in reversed(SERIES_WORDS.items()):
        out = F.when(_holds(t, words), column).otherwise(out)
    return out


def is_parameter(name: Column) -> Column:
    """Whether a variable's name means a parameter of the model rather than something it can be predicted from."""
    t = plain_words(name)
    words = F.arrays_overlap(F.split(t, " "), F.array(*map(F.lit, PARAMETER_WORDS)))
    return F.coalesce(words | _holds(t, PARAMETER_PARTS), F.lit(False))
