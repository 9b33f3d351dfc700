"""RDF terms, namespaces and the fixed vocabularies of the space domain.

A term is a struct ``(kind, value, datatype, lang)`` with no null fields, so that two terms are equal
just when the structs are; an unbound variable is a null struct. Triples are flat rows
``s, s_kind, p, o, o_kind, o_datatype, o_lang``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Namespace IRIs of the data model.
RESOURCE = "http://space-kg.org/resource/"
ONTOLOGY = "http://space-kg.org/ontology/"
ENTITY = "http://www.wikidata.org/entity/"
DIRECT = "http://www.wikidata.org/prop/direct/"
RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
RDFS = "http://www.w3.org/2000/01/rdf-schema#"
OWL = "http://www.w3.org/2002/07/owl#"
XSD = "http://www.w3.org/2001/XMLSchema#"
PROV = "http://www.w3.org/ns/prov#"
PREFIXES = {"skg-o": ONTOLOGY, "skg-r": RESOURCE, "wd": ENTITY, "wdt": DIRECT, "rdf": RDF, "rdfs": RDFS, "owl": OWL, "xsd": XSD, "prov": PROV}

TYPE, LABEL, COMMENT = f"{RDF}type", f"{RDFS}label", f"{RDFS}comment"
SUBCLASS, SUBPROPERTY, DOMAIN, RANGE = f"{RDFS}subClassOf", f"{RDFS}subPropertyOf", f"{RDFS}domain", f"{RDFS}range"
SAME_AS, EQUIVALENT_PROPERTY, SEE_ALSO = f"{OWL}sameAs", f"{OWL}equivalentProperty", f"{RDFS}seeAlso"
DERIVED_FROM = f"{PROV}wasDerivedFrom"

TRIPLE_COLUMNS = ("s", "s_kind", "p", "o", "o_kind", "o_datatype", "o_lang")
TRIPLE_SCHEMA = ", ".join(f"{c} string" for c in TRIPLE_COLUMNS)

# Mention labels kept, and the class of each.
LABEL_CLASSES = {
    "PERSON": "Person", "ORG": "SpaceAgency", "GPE": "CelestialBody", "LOC": "CelestialBody", "DATE": "TimePoint",
    "FAC": "Spacecraft", "PRODUCT": "Spacecraft", "EVENT": "SpaceMission", "Article": "Document",
}
TARGET_LABELS = ("PERSON", "ORG", "GPE", "DATE", "LOC", "FAC", "PRODUCT", "EVENT")

# Words that are no entity, pronouns that are no endpoint, verbs that are no predicate.
ENTITY_STOPWORDS = (
    "the", "a", "an", "this", "that", "these", "those", "he", "she", "it", "they", "we", "i", "you", "mr", "ms", "dr", "prof", "one", "two", "three", "many", "some", "other",
    "first", "last", "new", "old", "same", "great", "large", "small",
)
PRONOUNS = ("he", "she", "it", "they", "we", "i", "you", "this", "that", "these", "those", "who", "which")
SKIPPED_VERBS = ("be", "have", "do", "say", "make", "get", "go", "come", "know", "think", "see", "use", "find", "give", "take", "include", "contain", "become")

# Seed alignments, label -> (entity id, confidence).
SEEDS = {
    "nasa": ("Q23548", 1.0), "national aeronautics and space administration": ("Q23548", 1.0), "esa": ("Q42262", 1.0), "european space agency": ("Q42262", 1.0),
    "spacex": ("Q193701", 1.0), "space exploration technologies": ("Q193701", 0.9), "roscosmos": ("Q208419", 1.0), "jaxa": ("Q170964", 1.0), "isro": ("Q182566", 1.0),
    "csa": ("Q80817", 0.9), "canadian space agency": ("Q80817", 1.0), "neil armstrong": ("Q1615", 1.0), "buzz aldrin": ("Q2252", 1.0), "michael collins": ("Q313485", 1.0),
    "elon musk": ("Q317521", 1.0), "yuri gagarin": ("Q7327", 1.0), "john glenn": ("Q47361", 1.0), "alan shepard": ("Q312715", 1.0), "james webb": ("Q704332", 1.0),
    "chris hadfield": ("Q316272", 1.0), "valentina tereshkova": ("Q113366", 1.0), "apollo 11": ("Q43653", 1.0), "apollo 13": ("Q182252", 1.0), "apollo program": ("Q141060", 1.0),
    "artemis program": ("Q65078744", 1.0), "artemis": ("Q65078744", 0.9), "gemini program": ("Q192160", 1.0), "mercury program": ("Q193372", 1.0),
    "international space station": ("Q221291", 1.0), "iss": ("Q221291", 0.9), "hubble space telescope": ("Q2513", 1.0), "hubble": ("Q2513", 0.9),
    "james webb space telescope": ("Q184873", 1.0), "jwst": ("Q184873", 0.9), "falcon 9": ("Q657803", 1.0), "crew dragon": ("Q15824616", 1.0), "dragon": ("Q15824616", 0.85),
    "mars": ("Q111", 1.0), "moon": ("Q405", 1.0), "the moon": ("Q405", 1.0), "earth": ("Q2", 1.0), "sun": ("Q525", 1.0), "jupiter": ("Q319", 1.0), "saturn": ("Q193", 1.0),
    "venus": ("Q313", 1.0), "mercury": ("Q308", 0.85), "pluto": ("Q339", 1.0), "kennedy space center": ("Q134465", 1.0), "cape canaveral": ("Q208512", 1.0),
    "johnson space center": ("Q1127062", 1.0), "jet propulsion laboratory": ("Q193510", 1.0), "jpl": ("Q193510", 0.9),
}

# Property ids kept on expansion and their local names (None: known but skipped).
PREDICATES_KEPT = {
    "P1029": "hasAstronaut", "P137": "launchedBy", "P61": "discoveredBy", "P361": "partOf", "P131": "locatedIn", "P18": None, "P571": "foundedDate", "P576": "dissolvedDate",
    "P17": "country", "P277": None, "P856": None, "P569": "birthDate", "P570": "deathDate", "P106": "occupation", "P19": "birthPlace", "P27": "citizenship", "P21": "gender",
    "P22": "father", "P25": "mother", "P159": "headquarters", "P355": "subsidiary", "P452": "industry", "P31": "instanceOf", "P279": "subclassOf",
}

# Predicate alignment, local name -> (property id, relation, rationale).
PREDICATE_ALIGNMENT = {
    "hasAstronaut": ("P1029", EQUIVALENT_PROPERTY, "P1029 = 'crew member' - direct equivalent"),
    "launchedBy": ("P137", EQUIVALENT_PROPERTY, "P137 = 'operator' - equivalent for space missions"),
    "landedOn": ("P65", EQUIVALENT_PROPERTY, "P65 = 'site of astronomical discovery' is closest; approximate"),
    "partOf": ("P361", EQUIVALENT_PROPERTY, "P361 = 'part of' - exact equivalent"),
    "locatedIn": ("P131", SUBPROPERTY, "P131 = 'located in the administrative territorial entity' is broader"),
    "discoveredBy": ("P61", EQUIVALENT_PROPERTY, "P61 = 'discoverer or inventor' - direct equivalent"),
    "isCommanderOf": ("P1344", SUBPROPERTY, "P1344 = 'participant in' - isCommanderOf is a specialisation"),
}

# The ontology. Class -> comment (None: label only); property -> (domain, range, comment).
CLASSES = {
    "SpaceMission": "A crewed or uncrewed mission conducted in outer space.",
    "Astronaut": "A person trained and certified to travel in space.",
    "SpaceAgency": "A governmental or commercial organisation conducting space activities.",
    "CelestialBody": "A naturally occurring astronomical object (planet, moon, asteroid …).",
    "Spacecraft": "A vehicle designed to travel in outer space.",
    "Telescope": "An instrument for observing distant celestial objects.",
}
SUBCLASSES = (("Astronaut", "Person"), ("Telescope", "Spacecraft"), ("MissionCommander", "Astronaut"))
COMMANDER_COMMENT = "An astronaut who commands a space mission. Inferred via SWRL."
PROPERTIES = {
    "hasAstronaut": ("SpaceMission", "Astronaut", "Links a mission to a crew member."),
    "launchedBy": ("SpaceMission", "SpaceAgency", "Indicates the agency that launched the mission."),
    "landedOn": ("SpaceMission", "CelestialBody", "The celestial body on which a mission landed."),
    "partOf": (None, None, "Generic part-of relationship."),
    "locatedIn": (None, None, "Spatial containment relationship."),
    "discoveredBy": ("CelestialBody", "Person", "The person credited with discovering a celestial body."),
    "isCommanderOf": ("Astronaut", "SpaceMission", "An astronaut commands a specific mission."),
}
ONTOLOGY_LABEL = "Space Exploration Knowledge Graph Ontology"
ONTOLOGY_COMMENT = "Minimal ontology for the space-exploration domain."

# Classes by keyword in a URI; the first class with a hit wins.
CLASS_KEYWORDS = {
    "Astronaut": ("Astronaut", "Person", "Armstrong", "Shepard", "Conrad", "Glenn", "Collins"),
    "SpaceMission": ("Apollo", "Mission", "Artemis", "Gemini", "Mercury", "Soyuz", "Shuttle"),
    "SpaceAgency": ("NASA", "ESA", "SpaceX", "Roscosmos", "JAXA", "Agency"),
    "CelestialBody": ("Mars", "Moon", "Jupiter", "Saturn", "Earth", "Venus", "Mercury_planet", "Pluto", "asteroid"),
    "Telescope": ("Telescope", "Webb", "Hubble", "Spitzer"),
    "Spacecraft": ("Spacecraft", "Dragon", "Falcon", "Orion", "Soyuz_craft", "ISS", "Station"),
}
CLASS_COLOURS = {
    "SpaceAgency": "#4A90D9", "SpaceMission": "#E67E22", "CelestialBody": "#27AE60", "Astronaut": "#E74C3C", "Spacecraft": "#9B59B6", "Telescope": "#F39C12", "Other": "#95A5A6",
}
SPOTLIGHT = (f"{RESOURCE}NASA", f"{RESOURCE}Apollo_11", f"{RESOURCE}Mars")

# The preset questions.
QUESTIONS = (
    "Who were the astronauts of the Apollo 11 mission?",
    "What is the Hubble Space Telescope part of?",
    "Which agency launched the Hubble Space Telescope?",
    "What is the Hubble Space Telescope an instance of?",
    "What countries is SpaceX associated with?",
)


def triple(s: Column, p: Column | str, o: Column, o_kind: str | Column = "uri") -> Column:
    """A triple struct in the layout of the triple table."""
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    parts = {"s": s, "s_kind": F.lit("uri"), "p": lit(p), "o": o, "o_kind": lit(o_kind), "o_datatype": F.lit(""), "o_lang": F.lit("")}
    return F.struct(*[c.cast("string").alias(n) for n, c in parts.items()])


def term(kind: Column, value: Column, datatype: Column, lang: Column) -> Column:
    return F.struct(kind.alias("kind"), value.alias("value"), F.coalesce(datatype, F.lit("")).alias("datatype"), F.coalesce(lang, F.lit("")).alias("lang"))


def constant(kind: str, value: str, datatype: str = "", lang: str = "") -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(value).alias("value"), F.lit(datatype).alias("datatype"), F.lit(lang).alias("lang"))


TERM_TYPE = "struct<kind:string,value:string,datatype:string,lang:string>"
