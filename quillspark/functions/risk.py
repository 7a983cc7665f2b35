"""Risk tiers of action strings, as an ordered chain of patterns. Strings are classified, never run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tier and pattern, in the order in which they are tried.
STOP = 3
RULES = (
    (3, r"\b(sudo\s+rm\s+-rf\s*/\s*$|mkfs\.|dd\s+if=.*\s+of=/dev/)"),
    (3, r":\(\)\s*\{\s*:\s*\|\s*:\s*&\s*\}\s*;"),
    (2, r"(?:^|[;&|\n]\s*)find\b[^\n;|]*\s-(?:delete|exec|execdir|ok|okdir)\b"),
    (2, r"\brm\b[^\n;|]*\s--(?:recursive|force|dir)\b"),
    (2, r"\brmdir\b(?:[^\n;|]*\s(?:-p|--parents)\b)?"),
    (2, r"\bshred\b"),
    (2, r"(?i)\bgit\s+push\b[^\n;|]*\s(?:--force(?:-with-lease)?|-f)\b"),
    (2, r"\bpython3?\b[\s\S]{0,300}?\bshutil\.rmtree\s*\("),
    (2, r"\bpython3?\b[\s\S]{0,300}?\bos\.(?:remove|unlink|rmdir)\s*\("),
    (2, r"\brm\s+-rf\b"),
    (2, r"(?i)\bDROP\s+(TABLE|DATABASE|SCHEMA)\b"),
    (2, r"(?i)\bTRUNCATE\b"),
    (2, r"\bgit\s+push\s+(-f|--force)\b"),
    (2, r"\bgit\s+reset\s+--hard\b"),
    (2, r"(?i)\bDELETE\s+FROM\b"),
    (2, r"(?i)\b(?:rm|unlink)\s+-[a-z]*[rf]"),
    (2, r"\bchmod\s+[0-7]{3}\s+/(?:etc|usr|bin|boot)"),
    (0, r"^(?:cat|ls|grep|rg|find|diff|git\s+status|git\s+log|head|tail|wc|ps|stat)\b"),
)
# End of fixed values.
DEFAULT = 1


def risk_tier(action: Column, declared: Column | None = None) -> Column:
    """0 read-only, 1 reversible, 2 irreversible, 3 hard stop; a declared tier wins."""
    out = F.lit(DEFAULT)
    for tier, pattern in reversed(RULES):
        out = F.when(F.coalesce(action.rlike(pattern), F.lit(False)), F.lit(tier)).otherwise(out)
    return out if declared is None else F.coalesce(declared.cast("int"), out)
