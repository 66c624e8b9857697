"""Settings of a triage job. Values enter the plans as literals."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from mailtriage import constants as k
from mailtriage.templates import PROMPT_TEMPLATE


@dataclass(frozen=True)
class TriageConfig:
    """``catch_all`` is required: it is the reply address when the forwarder is unknown. ``model_id`` is handed to the
    scorer's factory and to request tables; ``in_flight`` is how many requests of a task wait at a time."""

    catch_all: str
    sender: str = ""
    domain: str = ""
    config_set: str = k.DEFAULT_CONFIG_SET
    recipients: tuple[str, ...] = ()
    model_id: str | None = None
    max_tokens: int = k.MAX_TOKENS
    temperature: float = k.TEMPERATURE
    in_flight: int = 1
    prompt_template: str = PROMPT_TEMPLATE
    ticket_token: str = field(default="", repr=False)
    ticket_owner: str = ""
    ticket_repo: str = ""

    def __post_init__(self) -> None:
        if not self.catch_all:
            raise ValueError("catch_all must be set: it receives replies to unknown forwarders")

    @classmethod
    def from_mapping(cls, settings: Mapping[str, object]) -> TriageConfig:
        """Build from a plain mapping; unknown names are ignored, a missing ``catch_all`` is an error."""
        known = {f.name for f in fields(cls)}
        values = {name: value for name, value in settings.items() if name in known and value is not None}
        return cls(**{"catch_all": "", **values})

    @property
    def reply_sender(self) -> str:
        if self.sender:
            return self.sender
        return f"noreply@{self.domain}" if self.domain else k.DEFAULT_SENDER

    @property
    def tickets_enabled(self) -> bool:
        return bool(self.ticket_token and self.ticket_owner and self.ticket_repo)
