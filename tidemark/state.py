"""What a run needs to go on after an interruption, as JSON."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

#: States of the version before held one position for all logs, which says nothing of any one of them.
VERSION, BEFORE = "2", "1"
#: Before the first event of a log.
START = -1


@dataclass
class RunState:
    """Last key by table as text (none: not begun), completed tables, positions by log, and keys to verify again.

    ``written`` and ``verified``: up to where each log is applied, and its keys
    are handed to the verifier; the ends of transactions. ``reverify``: (db,
    table, key as text, changes) of a few keys; of more, ``reverify_path`` says
    where they are.
    """

    last_keys: dict[str, object] = field(default_factory=dict)
    completed: list[str] = field(default_factory=list)
    written: dict[str, int] = field(default_factory=dict)
    verified: dict[str, int] = field(default_factory=dict)
    target_position: int = 0
    reverify: list[list] = field(default_factory=list)
    reverify_path: str = ""
    version: str = VERSION

    @property
    def written_position(self) -> int:
        """Up to where every log that was begun is applied; 0 if none was."""
        return min(self.written.values(), default=0)

    @property
    def verified_position(self) -> int:
        return min(self.verified.values(), default=0)

    def resume_from(self, log: str) -> int:
        """The lesser position of writer and verifier in a log, of those that there are; events after it are applied again."""
        return min((p for p in (self.written.get(log), self.verified.get(log)) if p), default=START)

    def dumps(self) -> str:
        return json.dumps(asdict(self), sort_keys=True)

    @classmethod
    def loads(cls, text: str) -> RunState:
        """A state; one of the version before goes on with its tables, and with every log from its beginning."""
        data = json.loads(text)
        if data.get("version") == BEFORE:
            for name in ("written_position", "verified_position"):
                data.pop(name, None)
            data["version"] = VERSION
        if data.get("version") != VERSION:
            raise ValueError(f"a state of version {data.get('version')} can't be resumed by version {VERSION}")
        return cls(**data)
