"""Settings of an engine and the fixed values that queries go by."""

from __future__ import annotations

from dataclasses import dataclass, field

# Galaxies whose entries are actors.
ACTOR_GALAXIES = (
    "mitre-intrusion-set", "mitre-enterprise-attack-intrusion-set", "mitre-mobile-attack-intrusion-set", "mitre-pre-attack-intrusion-set", "mitre-ics-groups", "threat-actor",
    "microsoft-activity-group", "360net-threat-actor", "groups", "intelligence-agency", "canada-listed-terrorist-entities",
)
# Galaxies that are searched unless a caller names others.
DEFAULT_SCOPE = (
    "malpedia", "threat-actor", "microsoft-activity-group", "360net-threat-actor", "intelligence-agency", "surveillance-vendor", "mitre-attack-pattern", "mitre-malware",
    "mitre-intrusion-set", "mitre-enterprise-attack-malware", "mitre-enterprise-attack-intrusion-set", "mitre-enterprise-attack-tool", "mitre-tool", "tool", "android", "stalkerware",
    "ransomware", "rat", "botnet", "banker", "backdoor", "stealer", "wiper", "exploit-kit", "cryptominers", "rmm-tool", "tds", "campaigns", "groups", "software", "technique",
)
SCOPE_ALL = "all"
# Words for how likely an attribution is.
LIKELIHOODS = ("almost-no-chance", "very-unlikely", "unlikely", "roughly-even-chance", "likely", "very-likely", "almost-certain")

# Bounds and defaults of queries, and how an undefined galaxy is shown.
MAX_VISITED = 20_000
MAX_DEPTH = 4
MAX_PATH_DEPTH = 6
GENERIC_FALLBACK = 9
GENERIC_PERCENTILE = 0.90
MIN_GENERIC_SAMPLE = 10
GENERIC_FLOOR = 2
CO_OCCURRENCE_RATE = 0.75
MIN_CO_OCCURRENCE_ACTORS = 5
MAX_CO_OCCURRENCE_CANDIDATES = 500
MAX_COMPARE_NEIGHBOURS = 2000
UNDEFINED_GALAXY = "(undefined in this checkout)"


@dataclass(frozen=True)
class Config:
    """actor_galaxies are compared in lower case; namespace is the first part of every tag; scope None searches everything."""

    actor_galaxies: tuple[str, ...] = ACTOR_GALAXIES
    scope: tuple[str, ...] | None = DEFAULT_SCOPE
    namespace: str = "galaxy"
    extra: dict = field(default_factory=dict, compare=False)
