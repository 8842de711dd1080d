"""Row-reducing actions by name."""

from __future__ import annotations

_ACTIONS: dict[str, type] = {}


def register_action(name: str):
    """Class decorator: ``reduce(df, action=name, **kwargs)`` then calls ``cls(**kwargs)(df)``."""

    def keep(cls: type) -> type:
        _ACTIONS[name] = cls
        return cls

    return keep


def get_action(name: str) -> type:
    if name not in _ACTIONS:
        raise ValueError(f"unknown action {name!r}; known: {sorted(_ACTIONS)}")
    return _ACTIONS[name]


def reduce(df, *, action: str, **kwargs):
    return get_action(action)(**kwargs)(df)
