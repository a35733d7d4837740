"""Levels and open sources of publication venues."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Venue keys (lower case, letters and digits only) by level.
# Keys that must match the whole venue:
EXACT = {
    "A": (
        "cvpr", "iccv", "neurips", "nips", "icml", "aaai", "ijcai", "acl", "iclr", "tpami", "ieeetpami",
        "ieeetransactionsonpatternanalysisandmachineintelligence", "ieeetransonpatternanalysisandmachineintelligence", "ijcv",
        "internationaljournalofcomputervision", "aij", "artificialintelligence",
    ),
    "B": (
        "eccv", "acmmm", "acminternationalconferenceonmultimedia", "icassp", "icip", "bmvc", "accv", "wacv", "emnlp", "naacl", "conll", "coling",
        "sigir", "www", "kdd", "icdm", "sdm", "ecml", "tip", "ieeetip", "ieeetransactionsonimageprocessing", "ieeetransonimageprocessing", "tnnls",
        "ieeetransactionsonneuralnetworksandlearningsystems", "ieeetransonneuralnetworksandlearningsystems", "tog", "acmtog",
        "acmtransactionsongraphics", "tcsvt", "ieeetransactionsoncircuitsandsystemsforvideotechnology",
        "ieeetransoncircuitsandsystemsforvideotechnology", "cviu", "computervisionandimageunderstanding", "pr", "patternrecognition",
    ),
    "C": (
        "icpr", "icme", "icann", "icig", "iconip", "signalprocessing", "ieeetransactionsonsignalprocessing", "neurocomputing", "ieeeaccess",
        "machinevisionandapplications", "mva",
    ),
}
# Short names that may stand inside a venue:
SHORT = {
    "A": (
        "cvpr", "iccv", "neurips", "nips", "icml", "aaai", "ijcai", "acl", "iclr", "tpami", "ijcv",
    ),
    "B": (
        "eccv", "acmmm", "icassp", "icip", "bmvc", "accv", "wacv", "emnlp", "naacl", "conll", "coling", "sigir", "www", "kdd", "icdm", "sdm", "ecml",
        "tip", "tnnls", "tog", "tcsvt", "cviu",
    ),
    "C": (
        "icpr", "icme", "icann", "icig", "iconip",
    ),
}
# Full names that may stand inside a venue, looked for after the short ones:
FULL = {
    "A": (
        "conferenceoncomputervisionandpatternrecognition", "internationalconferenceoncomputervision", "internationalconferenceonmachinelearning",
        "internationalconferenceonlearningrepresentations", "neuralinformationprocessingsystems",
        "annualmeetingoftheassociationforcomputationallinguistics", "artificialintelligence",
    ),
    "B": (
        "conferenceonacousticsspeechandsignalprocessing", "internationalconferenceonimageprocessing", "europeanconferenceoncomputervision",
        "conferenceonempiricalmethodsinnaturallanguageprocessing", "acminternationalconferenceonmultimedia", "acmmultimedia", "thewebconference",
        "patternrecognition",
    ),
    "C": (
        "signalprocessing", "neurocomputing", "ieeeaccess", "machinevisionandapplications",
    ),
}
# Open sources and the keys that lead to them, in order.
SOURCES = {
    "cvf": (
        "conferenceoncomputervisionandpatternrecognition", "cvpr", "internationalconferenceoncomputervision", "iccv",
    ),
    "acl": (
        "annualmeetingoftheassociationforcomputationallinguistics", "empiricalmethodsinnaturallanguageprocessing",
        "northamericanchapteroftheassociationforcomputationallinguistics", "computationalnaturallanguagelearning",
        "internationalconferenceoncomputationallinguistics", "naacl", "emnlp", "conll", "coling", "acl",
    ),
    "pmlr": (
        "internationalconferenceonmachinelearning", "europeanconferenceonmachinelearning", "icml", "ecml",
    ),
    "neurips": (
        "advancesinneuralinformationprocessingsystems", "neuralinformationprocessingsystems", "neurips", "nips",
    ),
    "openreview": (
        "internationalconferenceonlearningrepresentations", "iclr",
    ),
    "aaai": (
        "associationfortheadvancementofartificialintelligence", "aaai",
    ),
}


def venue_key(venue: Column) -> Column:
    return F.regexp_replace(F.lower(venue), "[^a-z0-9]", "")


def inside(levels: dict[str, tuple[str, ...]]) -> list[tuple[str, str]]:
    """(key, level), longest keys first, so that a key is tried before its own parts."""
    return sorted(((k, level) for level, keys in levels.items() for k in keys), key=lambda x: -len(x[0]))


def venue_level(venue: Column) -> Column:
    """A, B or C: by the whole key, then short names in it, then full names; else null."""
    key, out = venue_key(venue), None
    for level, keys in EXACT.items():
        out = F.when(key.isin(*keys), level) if out is None else out.when(key.isin(*keys), level)
    for k, level in inside(SHORT) + inside(FULL):
        out = out.when(F.contains(key, F.lit(k)), level)
    return out


def open_source(venue: Column) -> Column:
    """The open site that hosts a venue's papers; null where none is known."""
    key, out = venue_key(venue), F
    for source, keys in SOURCES.items():
        out = out.when(key.rlike("|".join(keys)), source)
    return out
