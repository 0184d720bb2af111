"""State of many sessions in the variables of one group of sessions."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.streaming import StatefulProcessorHandle


def _struct(schema: str) -> str:
    """The fields of a flat schema as a struct type."""
    return f"struct<{','.join(f.replace(' ', ':', 1) for f in schema.split(', '))}>"


class SessionStates:
    """Gives the processor of one session its state variables while the state belongs to a group of sessions.

    A variable of all sessions is one map of the group whose keys begin with the session.  ``turn`` says whose state is
    meant.  What a session reads or writes stays in memory until ``save``, which writes what has changed; a session that
    begins and ends between two saves never reaches the state.  ``held`` are the sessions that have stored state.
    """

    def __init__(self, handle: StatefulProcessorHandle, keys: str):
        self.handle, self.keys, self.variables = handle, keys, []
        self.session, self.held = None, set()

    def turn(self, session: tuple) -> None:
        self.session = session

    def getValueState(self, name: str, schema: str) -> SessionValue:  # noqa: N802
        value = SessionValue(self, self.handle.getMapState(name, self.keys, schema))
        self.variables.append(value)
        return value

    def getListState(self, name: str, schema: str) -> SessionList:  # noqa: N802
        return SessionList(self.getValueState(name, f"items array<{_struct(schema)}>"))

    def getMapState(self, name: str, key: str, value: str) -> SessionMap:  # noqa: N802
        found = SessionMap(self, self.handle.getMapState(name, f"{self.keys}, {key}", value))
        self.variables.append(found)  # saved before its list of keys
        found.index = self.getValueState(f"{name}_keys", f"found array<{_struct(key)}>")
        return found

    def save(self) -> None:
        for variable in self.variables:
            variable.save()


class SessionValue:
    """One row per session."""

    def __init__(self, states: SessionStates, rows):
        self.states, self.rows, self.read, self.changed = states, rows, {}, set()

    def get(self) -> tuple | None:
        s = self.states.session
        if s not in self.read:
            kept = self.rows.getValue(s) if s in self.states.held else None
            self.read[s] = None if kept is None else tuple(kept)
        return self.read[s]

    def exists(self) -> bool:
        return self.get() is not None

    def update(self, value: tuple) -> None:
        self.read[self.states.session] = value
        self.changed.add(self.states.session)

    def clear(self) -> None:
        self.update(None)

    def save(self) -> None:
        for s in self.changed:
            if self.read[s] is not None:
                self.rows.updateValue(s, self.read[s])
            elif s in self.states.held:
                self.rows.removeKey(s)
        self.read, self.changed = {}, set()


class SessionList:
    """A list per session, kept in one row."""

    def __init__(self, value: SessionValue):
        self.value = value

    def get(self) -> Iterator[tuple]:
        kept = self.value.get()
        return iter(kept[0] if kept is not None else [])

    def put(self, items: list[tuple]) -> None:
        self.value.update((items,))

    def clear(self) -> None:
        self.value.clear()


class SessionMap:
    """A map per session: a row per entry, which is read when it is asked for, and one row that lists the keys."""

    def __init__(self, states: SessionStates, rows):
        self.states, self.rows, self.index = states, rows, None
        # Entries by session; None for one that has not been read.
        self.read, self.changed, self.listed = {}, set(), set()

    def _entries(self) -> dict[tuple, tuple | None]:
        s = self.states.session
        if s not in self.read:
            kept = self.index.get()
            self.read[s] = dict.fromkeys(map(tuple, kept[0])) if kept is not None else {}
        return self.read[s]

    def containsKey(self, key: tuple) -> bool:  # noqa: N802
        return key in self._entries()

    def getValue(self, key: tuple) -> tuple:  # noqa: N802
        entries = self._entries()
        if entries[key] is None:
            entries[key] = tuple(self.rows.getValue((*self.states.session, *key)))
        return entries[key]

    def iterator(self) -> Iterator[tuple[tuple, tuple]]:
        return iter([(key, self.getValue(key)) for key in list(self._entries())])

    def updateValue(self, key: tuple, value: tuple) -> None:  # noqa: N802
        entries, s = self._entries(), self.states.session
        if key not in entries:
            self.listed.add(s)
        entries[key] = value
        self.changed.add((s, key))

    def removeKey(self, key: tuple) -> None:  # noqa: N802
        entries, s = self._entries(), self.states.session
        if key in entries:
            del entries[key]
            self.listed.add(s)
            self.changed.add((s, key))

    def clear(self) -> None:
        for key in list(self._entries()):
            self.removeKey(key)

    def save(self) -> None:
        for s, key in self.changed:
            if key in self.read[s]:
                self.rows.updateValue((*s, *key), self.read[s][key])
            elif s in self.states.held:
                self.rows.removeKey((*s, *key))
        for s in self.listed:
            self.states.turn(s)
            if self.read[s]:
                self.index.update((list(self.read[s]),))
            else:
                self.index.clear()
        self.read, self.changed, self.listed = {}, set(), set()
