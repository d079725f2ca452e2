"""Rule table: which commands share which reduction stages.

Fixed values: rule names, command prefixes, stage order, patterns, headers and
sizes decide the reduced text, so they are listed here as they must read.
"""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

STRIP = {"strategy": "ansi_strip"}


def _group(pattern: str) -> list[dict]:
    return [STRIP, {"strategy": "grouping", "pattern": pattern, "include_other": False}]


def _keys(noun: str = "issue(s)") -> list[dict]:
    return [{"strategy": "aggregate_by_key", "key": "prefix_before_colon",
             "header": "{lines} " + noun + " in {keys} file(s)", "top_n": 20}]


def _tail(n: int) -> list[dict]:
    return [STRIP, {"strategy": "tail_lines", "max_lines": n, "skip_blank": True}]


def _ends(n: int) -> list[dict]:
    return [STRIP, {"strategy": "head_tail", "head": n, "tail": n}]


def _stage(*names: str) -> list[dict]:
    return [{"strategy": n} for n in names]


_ERRORS = "^(.*(error|Error|ERROR).*)$"
_MSBUILD = "^(.*(?:error CS[0-9]+|Build FAILED|Build succeeded).*)$"
_PLAN = ("^(.*(Error|Plan:|will be created|will be destroyed|will be updated|successfully initialized"
         "|Success! The configuration is valid).*)$")
_FMT = [STRIP, {"strategy": "regex_capture", "pattern": "(?s)(.+)", "format": "$1", "fallback": "fmt: ok"}]
_STATE = [STRIP, {"strategy": "resource_graph", "key": "resource_type",
                  "header": "{lines} resources in {keys} types", "top_n": 20, "max_lines": 2000}]
_OUT_ERR = {"select_input": "stdout_then_stderr"}
_FAIL_RAW = {"gate": {"passthrough_nonzero_exit": True}}

RULES: list[tuple] = [
    ("ansible-playbook", ["ansible-playbook"], _group("^(.*(FAILED|fatal|ERROR|PLAY RECAP|failed=).*)$")),
    ("aws", ["aws"], _stage("json_structure")),
    ("basedpyright", ["basedpyright"], _keys()),
    ("biome", ["biome", "biome check", "biome lint"], _keys()),
    ("brew-install", ["brew install"], _group("^(.*(Error|error|ERROR).*)$")),
    ("bundle-install", ["bundle install"], _tail(10)),
    ("cargo-clippy", ["cargo clippy"], _stage("cargo_clippy_summary")),
    ("cargo-install", ["cargo install", "cargo build"], [STRIP, *_stage("cargo_install_summary")]),
    ("cargo-test", ["cargo test"], _stage("cargo_test_summary")),
    ("cat", ["cat"], _stage("cat_content")),
    ("composer-install", ["composer install", "composer update"], _group("^(.*(error|Error|ERROR).*)$")),
    ("curl", ["curl"], _tail(12), {"select_input": "stdout_or_stderr", **_FAIL_RAW}),
    ("df", ["df"], _group("^(.*(Filesystem|Use%|100%| 9[0-9]%).*)$")),
    ("docker-build", ["docker build"], [STRIP, *_stage("docker_build_summary")]),
    ("docker-logs", ["docker logs", "docker run", "docker exec"],
     [{"strategy": "tail_lines", "max_lines": 30, "skip_blank": True, "header_only_when_truncating": False}]),
    ("docker-ps", ["docker ps"], _stage("docker_ps")),
    ("dotnet-build", ["dotnet build"],
     [STRIP, *_stage("msbuild_binlog"), {"strategy": "grouping", "pattern": _MSBUILD}], _OUT_ERR),
    ("dotnet-format", ["dotnet format"],
     [STRIP, *_stage("format_report"), {"strategy": "grouping", "pattern": "^(.*(error|warning|Formatted).*)$"}],
     _OUT_ERR),
    ("dotnet-restore", ["dotnet restore"],
     [STRIP, *_stage("msbuild_binlog"), {"strategy": "tail_lines", "max_lines": 8, "skip_blank": True}]),
    ("dotnet-test", ["dotnet test"],
     [STRIP, *_stage("trx_report", "msbuild_binlog"),
      {"strategy": "grouping", "pattern": "^( {2}Failed .+|Failed!.*)$"}], _OUT_ERR),
    ("du", ["du"], _tail(8)),
    ("eslint", ["eslint", "npx eslint"], _stage("eslint_json", "eslint_text")),
    ("fail2ban", ["fail2ban-client"], _group("^(.*(ERROR|Banned|Jail).*)$")),
    ("find", ["find"], _stage("find_summary")),
    ("gcc", ["gcc", "g++"], _group("^(.*(error:).*)$")),
    ("gcloud", ["gcloud"], _group("^(.*(ERROR|Error).*)$")),
    ("gh", ["gh pr list", "gh pr view", "gh pr checks", "gh pr diff", "gh issue list", "gh issue view",
            "gh run list", "gh run view"], _stage("gh_summary")),
    ("git-add", ["git add"], _stage("git_add_summary")),
    ("git-commit", ["git commit"], _stage("git_commit_summary")),
    ("git-diff", ["git diff"], _stage("git_diff_summary")),
    ("git-log", ["git log"], _stage("git_log")),
    ("git-push", ["git push"], _stage("git_push_summary")),
    ("git-status", ["git status"], _stage("git_status")),
    ("glab", ["glab mr list", "glab mr view", "glab issue list", "glab issue view", "glab ci list", "glab ci view"],
     _stage("glab_summary")),
    ("go-test", ["go test"], _stage("go_test_summary")),
    ("golangci-lint", ["golangci-lint run"], _stage("golangci_summary")),
    ("gradle", ["gradle", "./gradlew"], _stage("gradle_summary")),
    ("grep", ["grep", "rg"], _stage("grep_summary"), {"select_input": "stdout"}),
    ("gt", ["gt"], _ends(8)),
    ("hadolint", ["hadolint"], _keys()),
    ("helm", ["helm install", "helm upgrade", "helm list"], _tail(12)),
    ("iptables", ["iptables"], [STRIP, {
        "strategy": "state_machine", "initial_state": "KEEP",
        "transitions": [
            {"from_state": "KEEP", "pattern": "^Chain (DOCKER|BR-)", "action": "DISCARD", "next_state": "SKIP"},
            {"from_state": "KEEP", "pattern": "^Chain ", "action": "EMIT", "next_state": "KEEP"},
            {"from_state": "SKIP", "pattern": "^Chain (DOCKER|BR-)", "action": "DISCARD", "next_state": "SKIP"},
            {"from_state": "SKIP", "pattern": "^Chain ", "action": "EMIT", "next_state": "KEEP"},
        ],
        "default_actions": {"KEEP": "EMIT", "SKIP": "DISCARD"}}]),
    ("jest", ["jest"], [STRIP, *_stage("jest_summary")]),
    ("jira", ["jira"], _ends(8)),
    ("jj", ["jj", "jj log", "jj status"], _ends(8)),
    ("jq", ["jq"], _stage("json_structure")),
    ("just", ["just"], _group("^(.*(error|Error|ERROR).*)$")),
    ("kubectl", ["kubectl"], _stage("kubectl_dispatch")),
    ("liquibase", ["liquibase"], _group("^(.*(ERROR|Error|error|changeset).*)$")),
    ("ls", ["ls"], _stage("tree_compression", "ls_empty_tree_fallback"), {"select_input": "stdout"}),
    ("make", ["make"], _stage("make_summary")),
    ("markdownlint", ["markdownlint", "markdownlint-cli2"], _keys()),
    ("mise", ["mise", "mise install"], _group("^(.*(error|Error|ERROR).*)$")),
    ("mix-compile", ["mix compile"], _group("^(.*(error|Error|compilation failed).*)$")),
    ("mix-format", ["mix format"], _ends(8)),
    ("msbuild", ["msbuild", "dotnet msbuild"],
     [STRIP, *_stage("msbuild_binlog"), {"strategy": "grouping", "pattern": _MSBUILD}], _OUT_ERR),
    ("mvn", ["mvn", "./mvnw"], _stage("mvn_summary")),
    ("mypy", ["mypy", "python -m mypy", "python3 -m mypy"], _keys()),
    ("next-build", ["next build"], _group("^(.*(Error|Failed).*)$")),
    ("npm-install", ["npm install", "npm ci", "npm i"], [STRIP, *_stage("npm_install_summary")]),
    ("nx", ["nx", "nx run", "nx build", "nx test"], _group("^(.*(error|Error|ERROR|failed|FAILED|NX).*)$")),
    ("ollama", ["ollama", "ollama run"], _group("^(.*(Error|error|ERROR).*)$")),
    ("oxlint", ["oxlint"], _keys()),
    ("ping", ["ping"], [STRIP, {
        "strategy": "regex_capture",
        "pattern": r"(?s).*?(\d+ packets transmitted, \d+ received, [^\r\n]+)", "format": "$1", "fallback": ""}]),
    ("pio-run", ["pio run"], _group("^(.*(error:|FAILED|Error).*)$")),
    ("pip-install", ["pip install", "pip3 install"], [STRIP, *_stage("pip_install_summary")]),
    ("playwright", ["playwright test", "npx playwright"], [STRIP, *_stage("playwright_summary")]),
    ("pnpm-install", ["pnpm install", "pnpm i", "pnpm add", "pnpm ci"],
     _group("^(.*(Packages:|ERR_|ERROR|vulnerabilit).*)$")),
    ("poetry-install", ["poetry install"], _group("^(.*(error|Error|ERROR).*)$")),
    ("pre-commit", ["pre-commit", "pre-commit run"], _group("^(.*(Failed|failed|error|Error).*)$")),
    ("prettier", ["prettier"], _group(r"^(.*(\[error\]|\[warn\]|SyntaxError).*)$")),
    ("prisma", ["prisma migrate", "prisma generate"], _group("^(.*(Error|Generated Prisma|Applied).*)$")),
    ("ps", ["ps"], _ends(8)),
    ("psql", ["psql"], [{"strategy": "head_tail", "head": 4, "tail": 6}]),
    ("pytest", ["pytest"], _stage("pytest_summary")),
    ("quarto-render", ["quarto render"], _group("^(.*(ERROR|Error|error).*)$")),
    ("rake", ["rake"], _group("^(.*(rake aborted|error|Error|ERROR).*)$")),
    ("rspec", ["rspec"], _group("^(.*(FAILED|Failed examples|rspec ./).*)$")),
    ("rsync", ["rsync"], _group("^(.*(rsync error|error|ERROR).*)$")),
    ("rubocop", ["rubocop"], _keys("offense(s)")),
    ("ruff", ["ruff check", "ruff"], _stage("ruff_summary")),
    ("shellcheck", ["shellcheck"], _keys()),
    ("shopify-theme", ["shopify theme"], _group("^(.*(error|Error|ERROR).*)$")),
    ("skopeo", ["skopeo"], _group("^(.*(error|Error|ERROR).*)$")),
    ("sops", ["sops"], _group("^(.*(error|Error|ERROR|encrypted|MAC).*)$"), _FAIL_RAW),
    ("spring-boot", ["spring-boot"], _group("^(.*(ERROR|Error|APPLICATION FAILED).*)$")),
    ("ssh", ["ssh"],
     _group("^(.*(Permission denied|Host key|Connection (refused|timed out|closed)|Could not resolve).*)$")),
    ("stat", ["stat"], _group("^(.*(File:|Size:|Access:|Modify:).*)$")),
    ("swift-build", ["swift build"], _group("^(.*(error:|Error).*)$")),
    ("systemctl-status", ["systemctl status"], _group("^(.*(Active:|error|Error|failed|Failed|Unit ).*)$")),
    ("task", ["task"], _group("^(.*(error|Error|ERROR|FAILED|Failed).*)$")),
    ("terraform-fmt", ["terraform fmt"], _FMT),
    ("terraform-state", ["terraform state list"], _STATE),
    ("terraform", ["terraform plan", "terraform apply", "terraform destroy", "terraform init", "terraform validate"],
     [STRIP, *_stage("machine_ui", "validate_json"), {"strategy": "grouping", "pattern": _PLAN}], _OUT_ERR),
    ("tofu-fmt", ["tofu fmt"], _FMT),
    ("tofu-state", ["tofu state list"], _STATE),
    ("tofu", ["tofu plan", "tofu apply", "tofu destroy", "tofu init", "tofu validate"],
     [STRIP, *_stage("machine_ui", "validate_json"), {"strategy": "grouping", "pattern": _PLAN}], _OUT_ERR),
    ("trunk-build", ["trunk", "trunk check"], _group("^(.*(error|Error|ERROR).*)$")),
    ("tsc", ["tsc"], _stage("tsc_summary")),
    ("turbo", ["turbo", "turbo run", "turbo build"], _group("^(.*(ERROR|error|failed|FAILED).*)$")),
    ("ty", ["ty", "ty check"], _keys()),
    ("uv-sync", ["uv sync"], _group("^(.*(error|Error|ERROR).*)$")),
    ("vitest", ["vitest"], _stage("vitest_summary")),
    ("wget", ["wget"], _tail(10)),
    ("xcodebuild", ["xcodebuild"], _group("^(.*(error:|BUILD FAILED).*)$")),
    ("yadm", ["yadm"], _ends(8)),
    ("yamllint", ["yamllint"], _keys()),
]

RULE_SCHEMA = T.StructType([
    T.StructField("rule", T.StringType(), False),
    T.StructField("prefix", T.StringType(), False),
    T.StructField("select_input", T.StringType(), True),
    T.StructField("passthrough_nonzero_exit", T.BooleanType(), False),
    T.StructField("passthrough_verbose", T.IntegerType(), True),
    T.StructField("passthrough_max_lines", T.IntegerType(), True),
])


def definitions() -> dict[str, dict]:
    """Built-in definitions by name."""
    out = {}
    for name, commands, stages, *extra in RULES:
        out[name] = {"name": name, "commands": commands, "stages": stages, **(extra[0] if extra else {})}
    return out


_DEFINITION_KEYS = {"schema_version", "name", "commands", "stages", "select_input", "gate", "tests"}


def load_definitions(texts: Sequence[str]) -> dict[str, dict]:
    """Definitions from TOML texts: known keys only, one owner per command."""
    out: dict[str, dict] = {}
    owner: dict[str, str] = {}
    for text in texts:
        d = tomllib.loads(text)
        unknown = set(d) - _DEFINITION_KEYS
        if unknown:
            raise ValueError(f"unknown keys in rule definition: {sorted(unknown)}")
        if d["name"] in out:
            raise ValueError(f"duplicate rule: {d['name']}")
        for command in d["commands"]:
            key = " ".join(command.lower().split())
            if key in owner:
                raise ValueError(f"command {key!r} is owned by {owner[key]} and {d['name']}")
            owner[key] = d["name"]
        out[d["name"]] = d
    return out


def rules_frame(spark: SparkSession, defs: Mapping[str, dict] | None = None) -> DataFrame:
    """One row per command prefix."""
    rows = []
    for d in (defs or definitions()).values():
        gate = d.get("gate") or {}
        for command in d["commands"]:
            rows.append((d["name"], " ".join(command.lower().split()), d.get("select_input"),
                         bool(gate.get("passthrough_nonzero_exit", False)),
                         gate.get("passthrough_verbose"), gate.get("passthrough_max_lines")))
    return spark.createDataFrame(rows, RULE_SCHEMA)


def duplicate_prefixes(rules: DataFrame) -> DataFrame:
    """Prefixes claimed by more than one rule (must be empty)."""
    return rules.groupBy("prefix").agg(F.count_distinct("rule").alias("owners")).where("owners > 1")
