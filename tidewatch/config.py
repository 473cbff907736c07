"""Settings from the environment, and what refuses to start."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from tidewatch.streaming.ingest import Settings


@dataclass(frozen=True)
class Config:
    data: str
    checkpoint: str
    secret: str
    query_secret: str = ""
    sites: tuple[str, ...] = ()
    path_hosts: tuple[str, ...] = ()
    app_tag: str = ""
    trigger: str = "5 minutes"
    keep_days: int = 0

    def __post_init__(self):
        if not self.data or not self.checkpoint:
            raise ValueError("DATA and CHECKPOINT are required")
        if self.data.rstrip("/") == self.checkpoint.rstrip("/"):
            raise ValueError("data and checkpoint must not be one folder")
        if len(self.secret) < 16:
            raise ValueError("SECRET needs 16 characters: visitor ids could be guessed back")
        if self.query_secret and self.query_secret == self.secret:
            raise ValueError("the query secret must not be the visitor secret")
        if self.keep_days < 0:
            raise ValueError("KEEP_DAYS must not be negative")

    @property
    def ingest(self) -> Settings:
        return Settings(self.secret.encode(), self.sites, self.app_tag, self.path_hosts)


def from_env(env: Mapping[str, str], prefix: str = "TIDEWATCH_") -> Config:
    get = lambda name, default="": env.get(prefix + name, default)
    some = lambda name: tuple(x.strip() for x in get(name).split(",") if x.strip())
    try:
        keep = int(get("KEEP_DAYS", "0"))
    except ValueError as e:
        raise ValueError("KEEP_DAYS is not a number") from e
    return Config(get("DATA"), get("CHECKPOINT"), get("SECRET"), get("QUERY_SECRET"), some("SITES"), some("PATH_HOSTS"), get("APP_TAG"), get("TRIGGER", "5 minutes"), keep)
