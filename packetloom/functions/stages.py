"""Attack stages: label rules and lookups as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stage names in order of their ids, and which of them are exploitation.
STAGES = ["Benign", "Reconnaissance", "InitialAccess", "LateralMovement", "CommandAndControl", "Exfiltration", "Impact"]
EXPLOIT = [2, 3, 4, 5, 6]
LATERAL_PORTS = [22, 23, 135, 139, 445, 3389, 5900, 5985]
# Substrings of botnet labels for Impact and Reconnaissance; the rest is command and control.
BOTNET_IMPACT = ["spam", "smtp", "-ad-", "http-ad", "click", "google", "web-established", "microsoft", "yieldmanager"]
BOTNET_RECON = ["dns", "attempt", "icmp", "scan"]
# The letter of each flag in a connection state.
FLAG_LETTERS = {"syn": "S", "fin": "F", "rst": "R", "psh": "P", "ack": "A", "urg": "U"}
# Ordered label rules, the first that matches decides.
RULES = [
    (4, ["c&c", "c2", "beacon"]),
    (1, ["scan", "recon", "probe", "portsweep", "analysis"]),
    (3, ["infilt", "lateral", "smb"]),
    (5, ["exfil", "backdoor"]),
    (6, ["dos", "ddos", "loic", "hoic", "slowloris", "hulk", "heartbleed"]),
    (2, ["brute", "patator", "sql", "xss", "web attack", "exploit", "shellcode", "fuzzer"]),
    (3, ["worm"]),
]


def _any(s: Column, needles: list[str]) -> Column:
    return F.coalesce(s.rlike("|".join(needles)), F.lit(False))


def stage_of(label: Column) -> Column:
    """The stage id of a raw label (null counts as benign)."""
    s = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    names = F.array_position(F.array(*[F.lit(x.lower()) for x in STAGES]), s)
    bot = F.contains(s, F.lit("botnet"))
    out = F.when(names > 0, names - 1).when(s.isin("", "nan", "benign") | (_any(s, ["background", "normal"]) & ~bot), 0)
    out = out.when(bot, F.when(_any(s, BOTNET_IMPACT), 6).when(_any(s, BOTNET_RECON), 1).otherwise(4)).when(s == "bot", 4)
    for stage, needles in RULES:
        out = out.when(_any(s, needles), stage)
    return out.otherwise(2).cast("int")


def protocol(p: Column) -> Column:
    """A protocol's number from its name or digits, else 0."""
    names = {"tcp": 6, "udp": 17, "icmp": 1, "ipv6-icmp": 58, "igmp": 2, "arp": 0}
    low = F.lower(F.trim(p))
    out = F.lit(None).cast("int")
    for k, v in names.items():
        out = F.when(low == k, v).otherwise(out)
    return F.coalesce(out, low.try_cast("double").cast("int"), F.lit(0))


def flag_counts(state: Column) -> dict[str, Column]:
    """Counts of the flag letters in a connection state string."""
    up = F.upper(F.coalesce(state, F.lit("")))
    return {flag: F.regexp_count(up, F.lit(letter)).cast("int") for flag, letter in FLAG_LETTERS.items()}


def monitored(ip: Column, prefixes: list[str]) -> Column:
    """Whether an address begins with any of the prefixes (none: all are monitored)."""
    out = F.lit(not prefixes)
    for p in prefixes:
        out = out | ip.startswith(p)
    return out


def cleaned(x: Column) -> Column:
    """A number from text: unparseable and infinite values are 0, negatives too."""
    v = x.try_cast("double")
    return F.greatest(F.coalesce(F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v), F.lit(0.0)), F.lit(0.0))


# Tactic, its id and techniques of each stage.
TACTICS = [
    ("-", "-", []),
    ("Reconnaissance", "TA0043", ["T1595 Active Scanning", "T1046 Network Service Discovery"]),
    ("Initial Access / Credential Access", "TA0001", ["T1110 Brute Force", "T1190 Exploit Public-Facing Application"]),
    ("Lateral Movement", "TA0008", ["T1021 Remote Services (SMB/RDP/SSH)", "T1570 Lateral Tool Transfer"]),
    ("Command and Control", "TA0011", ["T1071 Application Layer Protocol", "T1573 Encrypted Channel (beaconing)"]),
    ("Exfiltration", "TA0010", ["T1041 Exfiltration Over C2 Channel", "T1048 Exfiltration Over Alternative Protocol"]),
    ("Impact", "TA0040", ["T1498 Network Denial of Service", "T1499 Endpoint DoS"]),
]


def tactic(stage: Column) -> Column:
    """struct<tactic, id, techniques> of a stage."""
    each = [F.struct(F.lit(name).alias("tactic"), F.lit(key).alias("id"), F.lit(", ".join(techniques)).alias("techniques")) for name, key, techniques in TACTICS]
    return F.element_at(F.array(*each), stage + 1)


def status(risk: Column, threshold: float) -> Column:
    """Severity at the threshold or above, else NORMAL."""
    return F.when(risk >= threshold, severity(risk)).otherwise("NORMAL")


def severity(risk: Column) -> Column:
    return F.when(risk >= 0.9, "CRITICAL").when(risk >= 0.75, "HIGH").otherwise("MEDIUM")
