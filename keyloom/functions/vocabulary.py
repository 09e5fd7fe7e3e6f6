"""Domain vocabulary: groups of column-name aliases and value patterns."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.functions.names import name_form, name_form_col
from keyloom.session import small_table

# The built-in alias groups and value patterns, in matching order.
BUILTIN_NAME = "orcamento_federal_brasileiro"
BUILTIN_GROUPS: dict[str, list[str]] = {
    "empenho": ["nr_empenho", "num_empenho", "numero_empenho", "empenho", "cd_empenho", "cod_empenho", "ne", "nota_empenho"],
    "convenio": ["nr_convenio", "num_convenio", "numero_convenio", "convenio", "cd_convenio", "cod_convenio"],
    "orgao": ["cd_orgao", "cod_orgao", "codigo_orgao", "orgao", "nr_orgao", "id_orgao", "sg_orgao"],
    "unidade_orcamentaria": ["cd_uo", "cod_uo", "unidade_orcamentaria", "uo", "cd_unidade", "cod_unidade"],
    "programa": ["cd_programa", "cod_programa", "codigo_programa", "programa", "nr_programa"],
    "acao": ["cd_acao", "cod_acao", "codigo_acao", "acao", "nr_acao"],
    "funcao": ["cd_funcao", "cod_funcao", "codigo_funcao", "funcao"],
    "subfuncao": ["cd_subfuncao", "cod_subfuncao", "subfuncao"],
    "fonte_recurso": ["cd_fonte", "cod_fonte", "fonte_recurso", "fonte", "cd_fonte_recurso"],
    "natureza_despesa": ["cd_natureza", "cod_natureza", "natureza_despesa", "nd", "elemento_despesa", "cd_elemento"],
    "instrumento": ["nr_instrumento", "num_instrumento", "instrumento", "cd_instrumento", "id_instrumento"],
    "nota_credito": ["nr_nc", "nota_credito", "nc", "num_nc", "cd_nc"],
    "exercicio": ["exercicio", "ano_exercicio", "ano", "cd_ano", "nr_exercicio", "ds_ano"],
    "cpf_cnpj": ["cpf", "cnpj", "cpf_cnpj", "nr_cpf", "nr_cnpj", "documento", "nr_documento"],
    "municipio": ["cd_municipio", "cod_municipio", "municipio", "ibge", "cd_ibge", "codigo_ibge"],
    "uf": ["uf", "sg_uf", "cd_uf", "estado"],
}
BUILTIN_PATTERNS: dict[str, str] = {
    "empenho": r"^\d{4}NE\d{6}$",
    "convenio": r"^\d{6}/\d{4}$",
    "cpf": r"^\d{3}\.\d{3}\.\d{3}-\d{2}$",
    "cnpj": r"^\d{2}\.\d{3}\.\d{3}/\d{4}-\d{2}$",
    "orgao": r"^\d{5}$",
    "uo": r"^\d{5}$",
    "exercicio": r"^\d{4}$",
}


@dataclass(frozen=True)
class Vocabulary:
    """Alias groups and patterns; configuration-sized, so it lives in expressions."""

    name: str = BUILTIN_NAME
    groups: Mapping[str, list[str]] = field(default_factory=lambda: dict(BUILTIN_GROUPS))
    patterns: Mapping[str, str] = field(default_factory=lambda: dict(BUILTIN_PATTERNS))
    builtin: bool = True

    def overlay(self, contexts: Iterable[Mapping[str, list[str]]]) -> Vocabulary:
        """Stored groups replace same-named ones in place; new ones come last."""
        merged = dict(self.groups)
        for groups in contexts:
            merged.update(groups)
        return Vocabulary(self.name, merged, self.patterns, False)

    def group_of(self, name: Column, form: str = "match", min_partial_len: int = 0) -> Column:
        """Group of a column name: equal alias first, else an alias within the name or
        the name within an alias; the first group in order wins, NULL when none fits.

        ``min_partial_len`` drops short aliases and names from the second test, which
        otherwise see two-letter aliases inside unrelated names.
        """
        entries = [(g, name_form(a, form)) for g, aliases in self.groups.items() for a in aliases]
        if not entries:
            return F.lit(None).cast("string")
        # aliases and their groups as two constant arrays, folded before the job runs
        groups = F.split(F.lit("\n".join(g for g, _ in entries)), "\n")
        aliases = F.split(F.lit("\n".join(a for _, a in entries)), "\n")
        name = name_form_col(name, form)

        def overlaps(i: Column) -> Column:
            alias = F.element_at(aliases, i)
            inside = F.contains(name, alias) & (F.length(alias) >= min_partial_len)
            around = F.contains(alias, name) & (F.length(name) >= min_partial_len)
            return inside | around

        equal = F.array_position(aliases, name)
        partial = F.get(F.filter(F.sequence(F.lit(1), F.lit(len(entries))), overlaps), F.lit(0))
        at = F.when(equal > 0, equal.cast("int")).otherwise(partial)
        return F.get(groups, at - 1)


_CONTEXT_SCHEMA = "domain_name string, semantic_groups map<string,array<string>>, key_patterns map<string,string>"


def load_vocabulary(spark: SparkSession, path: str | None = None) -> Vocabulary:
    """Vocabulary from one JSON file; the built-in one when no file is there.

    A file without ``domain_name`` and ``semantic_groups``, or with groups that are
    not an object, is an error.  Group order in the file is kept.
    """
    if path is None:
        return Vocabulary()
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = files.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(files):
        return Vocabulary()
    text = spark.read.text(path, wholetext=True).head()[0]
    try:
        body = json.loads(text)
    except json.JSONDecodeError as exc:
        raise ValueError(f"not a vocabulary file: {path}: {exc}") from exc
    missing = {"domain_name", "semantic_groups"} - set(body)
    if missing:
        raise ValueError(f"vocabulary file {path} lacks {sorted(missing)}")
    if not isinstance(body["semantic_groups"], dict):
        raise ValueError(f"vocabulary file {path}: 'semantic_groups' must be an object")
    return Vocabulary(body["domain_name"], body["semantic_groups"], body.get("key_patterns", {}), False)


def vocabulary_table(spark: SparkSession, vocabulary: Vocabulary, source: str | None = None) -> DataFrame:
    """The vocabulary as one row of the stored-contexts table."""
    row = (vocabulary.name, list(vocabulary.groups.items()), list(vocabulary.patterns.items()))
    origin = source or ("builtin" if vocabulary.builtin else "user-defined")
    return small_table(spark, [row], _CONTEXT_SCHEMA).withColumn("source", F.lit(origin))
