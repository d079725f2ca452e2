"""Discovery rules: which files of a repository point at which definitions.

Fixed values: (rule, family, priority, signal paths, recommended definitions).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_DOTNET = ["dotnet-test", "dotnet-build", "dotnet-restore", "dotnet-format", "msbuild"]

DISCOVERY_RULES: list[tuple[str, str, int, list[str], list[str]]] = [
    ("docker", "docker", 10, ["Dockerfile"], ["docker-build"]),
    ("dotnet-directory-build", "dotnet", 30, ["Directory.Build.props"], _DOTNET),
    ("dotnet-global", "dotnet", 10, ["global.json"], _DOTNET),
    ("dotnet-nuget", "dotnet", 20, ["nuget.config"], _DOTNET),
    ("extra-ansible", "ansible", 10, ["ansible.cfg"], ["ansible-playbook"]),
    ("extra-basedpyright", "basedpyright", 10, ["pyrightconfig.json"], ["basedpyright"]),
    ("extra-biome", "biome", 10, ["biome.json", "biome.jsonc"], ["biome"]),
    ("extra-composer", "php", 10, ["composer.lock"], ["composer-install"]),
    ("extra-eslint", "eslint", 10, ["eslint.config.js", ".eslintrc.json"], ["eslint"]),
    ("extra-just", "just", 10, ["justfile"], ["just"]),
    ("extra-justfile", "just", 20, ["Justfile"], ["just"]),
    ("extra-markdownlint", "markdownlint", 10, [".markdownlint.json"], ["markdownlint"]),
    ("extra-mise", "mise", 10, ["mise.toml"], ["mise"]),
    ("extra-mix", "elixir", 10, ["mix.exs"], ["mix-compile"]),
    ("extra-mypy", "mypy", 10, ["mypy.ini"], ["mypy"]),
    ("extra-next", "next", 10, ["next.config.js", "next.config.mjs", "next.config.ts"], ["next-build"]),
    ("extra-nx", "nx", 10, ["nx.json"], ["nx"]),
    ("extra-oxlint", "oxlint", 10, [".oxlintrc.json"], ["oxlint"]),
    ("extra-playwright", "playwright", 10, ["playwright.config.ts", "playwright.config.js"], ["playwright"]),
    ("extra-poetry", "poetry", 10, ["poetry.lock"], ["poetry-install"]),
    ("extra-pre-commit", "pre-commit", 10, [".pre-commit-config.yaml"], ["pre-commit"]),
    ("extra-prettier", "prettier", 10, [".prettierrc", ".prettierrc.json", "prettier.config.js"], ["prettier"]),
    ("extra-prisma", "prisma", 10, ["prisma/schema.prisma"], ["prisma"]),
    ("extra-pytest", "pytest", 10, ["pytest.ini", "conftest.py"], ["pytest"]),
    ("extra-quarto", "quarto", 10, ["_quarto.yml"], ["quarto-render"]),
    ("extra-rspec", "rspec", 10, [".rspec"], ["rspec"]),
    ("extra-rubocop", "rubocop", 10, [".rubocop.yml"], ["rubocop"]),
    ("extra-ruff", "ruff", 10, ["ruff.toml", ".ruff.toml"], ["ruff"]),
    ("extra-sops", "sops", 10, [".sops.yaml"], ["sops"]),
    ("extra-swift", "swift", 10, ["Package.swift"], ["swift-build"]),
    ("extra-task", "task", 10, ["Taskfile.yml"], ["task"]),
    ("extra-tsc", "tsc", 10, ["tsconfig.json"], ["tsc"]),
    ("extra-turbo", "turbo", 10, ["turbo.json"], ["turbo"]),
    ("extra-uv", "uv", 10, ["uv.lock"], ["uv-sync"]),
    ("extra-yamllint", "yamllint", 10, [".yamllint"], ["yamllint"]),
    ("git", "git", 10, [".git"], ["git-status", "git-diff", "git-log"]),
    ("go", "go", 10, ["go.mod"], ["go-test", "golangci-lint"]),
    ("infra-helm", "helm", 10, ["Chart.yaml"], ["helm"]),
    ("infra-opentofu", "opentofu", 10, [".opentofu-version", ".terraform.lock.hcl", "main.tf"],
     ["tofu", "tofu-fmt", "tofu-state"]),
    ("infra-terraform", "terraform", 10, [".terraform.lock.hcl", "main.tf"],
     ["terraform", "terraform-fmt", "terraform-state"]),
    ("java-gradle", "java-build", 20, ["build.gradle", "build.gradle.kts"], ["gradle"]),
    ("java-make", "java-build", 30, ["Makefile"], ["make"]),
    ("java-mvn", "java-build", 10, ["pom.xml"], ["mvn"]),
    ("js-npm-lock", "js-install", 20, ["package-lock.json"], ["npm-install"]),
    ("js-npm", "js-install", 30, ["package.json"], ["npm-install"]),
    ("js-pnpm", "js-install", 10, ["pnpm-lock.yaml"], ["pnpm-install"]),
    ("python-pipfile", "python", 30, ["Pipfile.lock"], ["pip-install"]),
    ("python-pyproject", "python", 10, ["pyproject.toml"], ["pip-install"]),
    ("python-requirements", "python", 20, ["requirements.txt"], ["pip-install"]),
    ("ruby", "ruby", 10, ["Gemfile.lock"], ["bundle-install"]),
    ("rust", "rust", 10, ["Cargo.toml"], ["cargo-test", "cargo-clippy"]),
]


def signals_frame(spark: SparkSession, rules=None) -> DataFrame:
    """One row per signal; a rule given as a sixth element (path, needles) pairs needs all needles."""
    rows = []
    for rule, family, priority, signals, recommend, *extras in rules or DISCOVERY_RULES:
        for i, path in enumerate(signals):
            rows.append((rule, family, priority, i, path, [], recommend))
        for j, (path, needles) in enumerate(extras[0] if extras else []):
            rows.append((rule, family, priority, len(signals) + j, path, list(needles), recommend))
    return spark.createDataFrame(rows, "rule string, family string, priority int, signal_no int, path string, "
                                       "needles array<string>, recommend array<string>")
