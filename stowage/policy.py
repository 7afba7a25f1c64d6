"""The policy of a packed column: compression level, dictionary slot, and whether a change is pending."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

LEVELS = range(1, 23)
MAX_SLOT = 33_554_431


class PolicyError(ValueError):
    pass


@dataclass(frozen=True)
class Policy:
    level: int = 6
    slot: int = 0
    pending: bool = False

    def __post_init__(self):
        if self.level not in LEVELS:
            raise PolicyError(f"level {self.level} is outside 1..22")
        if not 0 <= self.slot <= MAX_SLOT:
            raise PolicyError(f"dictionary slot {self.slot} is outside 0..{MAX_SLOT}")

    @classmethod
    def parse(cls, text: str, slot_of: Callable[[str], int] | None = None) -> Policy | None:
        """``(level [, dictionary [, pending]])``; '' is no policy (a bare column). The dictionary is a
        slot, if it has digits only, or a registered name, which ``slot_of`` resolves once and for all."""
        text = text.strip()
        if not text:
            return None
        if not (text.startswith("(") and text.endswith(")")):
            raise PolicyError(f"a policy is (level [, dictionary [, pending]]), not {text!r}")
        words = re.findall(r"""\s*('(?:[^']|'')*'|"(?:[^"]|"")*"|[^,]*)\s*(?:,|$)""", text[1:-1])
        words = words[:-1] if words and not words[-1] and len(words) > text.count(",") + 1 else words
        words = [w.strip() for w in words]
        if not 1 <= len(words) <= 3 or any(not w for w in words):
            raise PolicyError(f"a policy has one to three words, not {text!r}")
        if not re.fullmatch(r"\d+", words[0]):
            raise PolicyError(f"invalid level {words[0]!r}")
        slot = 0
        if len(words) > 1:
            name = words[1]
            if name[0] in "'\"":
                name = name[1:-1].replace(name[0] * 2, name[0])
            else:
                name = name.lower()
            if re.fullmatch(r"\d+", name):
                slot = int(name)
            elif slot_of is None:
                raise PolicyError(f"no registry to look up dictionary {name!r} in")
            else:
                slot = slot_of(name)
        if len(words) == 3 and words[2].lower() != "pending":
            raise PolicyError(f"the third word must be pending, not {words[2]!r}")
        return cls(int(words[0]), slot, len(words) == 3)

    def __str__(self) -> str:
        words = [str(self.level)] + [str(self.slot)] * (self.slot > 0 or self.pending) + ["pending"] * self.pending
        return f"({','.join(words)})"

    def metadata(self, kind: str) -> dict:
        return {"packed": {"kind": kind, "level": self.level, "slot": self.slot, "pending": self.pending}}

    @classmethod
    def of_metadata(cls, metadata: dict) -> Policy | None:
        held = (metadata or {}).get("packed")
        return cls(held["level"], held["slot"], held["pending"]) if held and held.get("level") is not None else None


DEFAULT = Policy()
