"""Command line: python -m quern.cli lex TEXT | tables | console SF_DIR."""

from __future__ import annotations

import sys

from quern.access import Directory, decisions
from quern.lang.diag import QueryError
from quern.lang.lexer import tokenize

SHOWN = 1000  # rows that the console prints at most
HELP = r"""\q quit  \dt objects  \d NAME fields  \set NAME VALUE parameter  \unset NAME  \params  \plan TEXT
\users  \user NAME  \roles [PART]  \role NAME [OBJECT]  \template ROLE [NAME]  \rls [OBJECT] rules in force  \as [USER | clear]
end a statement with an empty line"""


def describe(model, name: str | None = None) -> list[str]:
    if name is None:
        return [o.full_name for o in model.objects]
    kind, _, rest = name.partition(".")
    obj = model.find(kind, rest)
    return [f"{f.name}\t{f.kind}\t{', '.join(f.targets)}" for f in obj.fields] if obj else [f"no object {name}"]


class Access:
    """The commands for users, roles and restrictions. Acting as a user puts the engine under the rules of the user's roles."""

    def __init__(self, engine, directory: Directory):
        self.engine, self.directory, self.user = engine, directory, None
        self.before = (engine.restricted, engine.restrictions)

    def run(self, word: str, rest: str) -> str | None:
        """The answer; None if the word is no command of these."""
        command = getattr(self, f"on_{word[1:]}", None)
        return None if command is None else command(rest)

    def on_users(self, _: str) -> str:
        return "\n".join(f"{name}\t{', '.join(roles)}" for name, roles in sorted(self.directory.users.items()))

    def on_user(self, name: str) -> str:
        roles = self.directory.users.get(name)
        return f"no user {name}" if roles is None else f"{name}: {', '.join(roles)}"

    def on_roles(self, part: str) -> str:
        return "\n".join(r.name for r in self.directory.roles if part.lower() in r.name.lower())

    def on_role(self, rest: str) -> str:
        name, _, last = rest.rpartition(" ")
        name, obj = (name, last) if name and "." in last else (rest, None)
        role = self.directory.role(name)
        if role is None:
            return f"no role {name}"
        says = {True: "all rows", False: "nothing"}
        return "\n".join(f"{o}\t{says.get(r, r)}" for o, r in sorted(role.rights.items()) if obj is None or o == obj)

    def on_template(self, rest: str) -> str:
        name, _, template = rest.rpartition(" ")
        role = self.directory.role(name) or self.directory.role(rest)
        if role is None:
            return f"no role {name or rest}"
        return role.templates.get(template, f"no template {template}") if name else "\n".join(sorted(role.templates))

    def on_rls(self, obj: str) -> str:
        says = {None: "all rows", False: "nothing"}
        return "\n".join(str(says.get(r, r)) if obj else f"{o}\t{says.get(r, r)}" for o, r in sorted(self.engine.restrictions.items()) if not obj or o == obj)

    def on_as(self, name: str) -> str:
        if not name:
            return f"current user: {self.user}" if self.user else "no current user"
        if name == "clear":
            self.user, (self.engine.restricted, self.engine.restrictions) = None, self.before
            return "current user cleared"
        if name not in self.directory.users:
            return f"no user {name}"
        roles = self.directory.roles_of(name)
        objects = [o for x in self.engine.model.objects for o in (x.full_name, *(s.full_name for s in x.sections.values()))]
        self.engine.restrictions = decisions(roles, objects, self.engine.session)
        self.user, self.engine.restricted = name, True
        return f"current user: {name} ({', '.join(r.name for r in roles)})"


def console(engine, lines, out=print, directory: Directory | None = None) -> None:
    """Read statements from lines; parameters set here apply to those that a text mentions."""
    params: dict = {}
    access = Access(engine, directory or Directory({}, []))
    held: list[str] = []
    for line in lines:
        line = line.rstrip("\n")
        if not held and line.startswith("\\"):
            word, _, rest = line.partition(" ")
            if word == "\\q":
                return
            if word == "\\help":
                out(HELP)
            elif word in ("\\dt", "\\tables"):
                out("\n".join(describe(engine.model)))
            elif word == "\\d":
                out("\n".join(describe(engine.model, rest.strip())))
            elif word == "\\set":
                name, _, value = rest.partition(" ")
                params[name] = int(value) if value.lstrip("-").isdigit() else value.strip('"')
            elif word == "\\unset":
                params.pop(rest.strip(), None)
            elif word == "\\params":
                out("\n".join(f"{k} = {v!r}" for k, v in params.items()))
            elif word == "\\plan":
                out(engine.query(rest)._jdf.queryExecution().toString())
            elif (answer := access.run(word, rest.strip())) is not None:
                out(answer)
            else:
                out(f"unknown command {word}; \\help lists them")
            continue
        if line.strip():
            held.append(line)
        elif held:
            _run(engine, "\n".join(held), params, out)
            held = []
    if held:
        _run(engine, "\n".join(held), params, out)


def _run(engine, text: str, params: dict, out) -> None:
    try:
        wanted = {n.lower() for n in engine.prepare(text)["parameters"]}
        df = engine.query(text, {k: v for k, v in params.items() if k.lower() in wanted})
        out("\t".join(df.columns))
        for row in df.take(SHOWN):
            out("\t".join("" if v is None else str(v) for v in row))
    except QueryError as e:
        out(f"error: {e}")


def main(args: list[str]) -> int:
    if args[:1] == ["lex"]:
        for t in tokenize(" ".join(args[1:])):
            print(t.at, t.kind, t.keyword or t.text)
    elif args[:1] == ["tables"]:
        from quern.sample_model import model

        print("\n".join(describe(model())))
    elif args[:1] == ["console"] and len(args) == 2:
        from pyspark.sql import SparkSession

        from quern.sample_model import engine

        spark = SparkSession.builder.appName("quern").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        console(engine(spark, args[1]), sys.stdin)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
