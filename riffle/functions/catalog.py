"""The catalog of Python frameworks, sources, sinks, sanitizers and sensitive names: data, which a caller can replace by a JSON file."""

from __future__ import annotations

import json
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

Catalog = Mapping[str, Mapping]

# What detects a framework, makes a route, guards or opens it, and brings in requests.
FRAMEWORKS = {
    "flask": {
        "detect": ["flask", "quart"],
        "routes": ["app.route", "bp.route", "blueprint.route", "app.get", "app.post", "app.put", "app.patch", "app.delete"],
        "method_kwarg": "methods",
        "guards": ["login_required", "fresh_login_required", "roles_required", "roles_accepted", "permissions_required", "jwt_required", "auth.login_required"],
        "openers": ["login_exempt", "csrf.exempt"],
        "attributes": ["request.args", "request.form", "request.json", "request.values", "request.data", "request.files", "request.headers", "request.cookies", "request.view_args", "request.get_json"],
    },
    "fastapi": {
        "detect": ["fastapi", "starlette"],
        "routes": ["app.get", "app.post", "app.put", "app.patch", "app.delete", "app.head", "app.options", "router.get", "router.post", "router.put", "router.patch", "router.delete", "api_router.get", "api_router.post"],
        "dependencies": True,
        "attributes": ["request.query_params", "request.path_params", "request.headers", "request.cookies", "request.body", "request.json", "request.form"],
    },
    "django": {
        "detect": ["django", "rest_framework"],
        "views": ["View", "TemplateView", "ListView", "DetailView", "CreateView", "UpdateView", "DeleteView", "APIView", "GenericAPIView", "ViewSet", "ModelViewSet", "ReadOnlyModelViewSet"],
        "guards": ["login_required", "permission_required", "user_passes_test", "staff_member_required", "api_view"],
        "mixins": ["LoginRequiredMixin", "PermissionRequiredMixin", "UserPassesTestMixin"],
        "class_attributes": ["permission_classes", "authentication_classes"],
        "enforcing": ["IsAuthenticated", "IsAdminUser", "IsAuthenticatedOrReadOnly", "DjangoModelPermissions", "DjangoObjectPermissions"],
        "openers": ["AllowAny"],
        "attributes": ["request.GET", "request.POST", "request.body", "request.META", "request.COOKIES", "request.FILES", "request.data", "request.query_params"],
    },
}
# Untrusted inputs, by group.
SOURCES = {
    "environment": {"calls": ["os.getenv", "os.environ.get", "environ.get"]},
    "filesystem": {"calls": ["open", "Path.read_text", "Path.read_bytes", "json.load", "csv.reader"]},
    "network": {"calls": ["socket.recv", "requests.get", "httpx.get", "urlopen"]},
    "message_queue": {"calls": ["basic_consume", "receive_messages"], "exact_calls": ["consume", "poll"]},
    "cli": {"attributes": ["sys.argv"]},
}
# Dangerous calls, by class.
SINKS = {
    "sql": {"calls": ["cursor.execute", "cursor.executemany", "cursor.executescript", "connection.execute", "session.execute", "engine.execute", "objects.raw", "objects.extra", "RawSQL"], "exact_calls": ["text", "sa.text", "sqlalchemy.text"]},
    "command": {"calls": ["subprocess.run", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.Popen", "os.system", "os.popen", "os.execv", "os.spawnv", "pty.spawn"]},
    "code_exec": {"exact_calls": ["eval", "exec"], "calls": ["__import__", "importlib.import_module"]},
    "template": {"calls": ["render_template_string", "Template.render", "jinja2.Template", "from_string", "mark_safe", "format_html"]},
    "path": {"calls": ["open", "send_file", "send_from_directory", "shutil.copy", "shutil.move", "os.remove", "os.rename", "Path.write_text", "Path.write_bytes", "extractall"]},
    "deserialize": {"calls": ["pickle.load", "pickle.loads", "marshal.loads", "dill.loads", "jsonpickle.decode", "shelve.open"]},
    "http_outbound": {"calls": ["requests.get", "requests.post", "requests.put", "requests.delete", "requests.request", "httpx.get", "httpx.post", "httpx.request", "urllib.request.urlopen", "aiohttp.ClientSession.get", "aiohttp.ClientSession.post"]},
    "log": {"calls": ["logging.info", "logging.debug", "logging.warning", "logging.error", "logging.exception", "logger.info", "logger.debug", "logger.warning", "logger.error", "logger.exception", "print"]},
    "response": {"calls": ["HttpResponse", "JsonResponse", "make_response", "jsonify", "Response"]},
}
# What makes an input harmless for a class of sinks.
SANITIZERS = {
    "sql": {"calls": ["sql.Identifier", "sql.Literal", "bindparam", "mogrify"]},
    "command": {"calls": ["shlex.quote", "shlex.split", "pipes.quote"]},
    "template": {"exact_calls": ["escape"], "calls": ["html.escape", "markupsafe.escape", "bleach.clean", "conditional_escape"]},
    "path": {"calls": ["secure_filename", "os.path.abspath", "os.path.realpath", "Path.resolve", "os.path.basename"]},
    "deserialize": {"calls": ["json.loads", "yaml.safe_load"]},
    "http_outbound": {"calls": ["urlparse", "validate_url", "is_allowed_host"]},
    "response": {"calls": ["serializers.serialize", "model_to_dict"]},
}
# Names of sensitive fields, by class.
SENSITIVE = {
    "credential": ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "client_secret", "session_key", "refresh_token", "otp"],
    "pii": ["ssn", "social_security", "national_id", "passport", "drivers_license", "dob", "date_of_birth", "email", "phone", "address", "full_name", "ip_address"],
    "financial": ["credit_card", "card_number", "cardnumber", "cvv", "cvc", "iban", "account_number", "routing_number", "salary", "balance"],
    "health": ["diagnosis", "medical_record", "mrn", "patient_id", "prescription", "icd"],
}
# Files of which a change makes a whole profile necessary.
ANCHORS = ("requirements*.txt", "pyproject.toml", "Pipfile", "setup.py", "setup.cfg", "**/settings.py", "**/settings/*.py", "**/urls.py", "**/middleware.py", "**/permissions.py", "**/auth.py", "**/authentication.py", "**/security.py", "**/conftest.py", "Dockerfile*", "**/*.tf")
HTTP_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
PYTHON: Catalog = {"frameworks": FRAMEWORKS, "sources": SOURCES, "sinks": SINKS, "sanitizers": SANITIZERS, "sensitive": SENSITIVE}


def _no_repeats(pairs: list[tuple[str, object]]) -> dict:
    names = [k for k, _ in pairs]
    if repeated := sorted({k for k in names if names.count(k) > 1}):
        raise ValueError(f"keys that are there twice: {repeated}")
    return dict(pairs)


def load(text: str) -> Catalog:
    """A catalog of this module's form from JSON; a key that is there twice is an error, as the later one would hide the earlier."""
    return json.loads(text, object_pairs_hook=_no_repeats)


def call_patterns(catalog: Catalog = PYTHON) -> list[tuple[int, str, bool, str, str]]:
    """(ordinal, pattern, exact, kind, detail) of sinks, sanitizers and sources. One pattern in both modes is an error."""
    rows, modes = [], {True: set(), False: set()}
    for block, kind in (("sinks", "sink"), ("sanitizers", "sanitizer"), ("sources", "source")):
        for detail, entry in catalog.get(block, {}).items():
            for exact in (False, True):
                for p in entry.get("exact_calls" if exact else "calls", ()):
                    modes[exact].add(p)
                    rows.append((len(rows), p, exact, kind, detail))
    if both := sorted(modes[True] & modes[False]):
        raise ValueError(f"patterns in both modes: {both}")
    return rows


def attribute_patterns(catalog: Catalog = PYTHON) -> list[tuple[int, str, str]]:
    """(ordinal, pattern, group): what brings in requests, by framework, then other sources."""
    rows = [(p, f"request:{name}") for name, fw in catalog.get("frameworks", {}).items() for p in fw.get("attributes", ())]
    rows += [(p, group) for group, entry in catalog.get("sources", {}).items() for p in entry.get("attributes", ())]
    last = {p: g for p, g in rows}  # a pattern of several groups counts for the last, at its first place
    return [(i, p, last[p]) for i, p in enumerate(last)]


def sensitive_terms(catalog: Catalog = PYTHON) -> list[tuple[str, str]]:
    """(term, class) in order."""
    return [(t, c) for c, terms in catalog.get("sensitive", {}).items() for t in terms]


def route_verbs(catalog: Catalog = PYTHON) -> set[str]:
    """Last names of decorators that make a route, whatever object they are called on."""
    return {r.rsplit(".", 1)[-1] for fw in catalog.get("frameworks", {}).values() for r in fw.get("routes", ())}


def framework_rows(catalog: Catalog, key: str) -> list[tuple[str, str]]:
    """(framework, last name) of one list of every framework."""
    return [(name, x.rsplit(".", 1)[-1]) for name, fw in catalog.get("frameworks", {}).items() for x in fw.get(key, ())]


def table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Catalog rows as a DataFrame: a constant of the program, of some hundred rows."""
    return spark.createDataFrame(rows, schema)
