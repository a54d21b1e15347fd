"""Small objects over single rows; what costs a query is computed on first use."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from typing import TYPE_CHECKING

from pyspark.sql import Row
from pyspark.sql import functions as F

from phylolake.functions import strings
from phylolake.operators import hierarchy, summary
from phylolake.operators.relations import REL_TYPES

if TYPE_CHECKING:
    from phylolake.api import Release


@dataclass
class _Model:
    release: Release
    row: Row

    def __getattr__(self, name):
        if name.startswith("_") or "row" not in self.__dict__ or name not in self.row.__fields__:
            raise AttributeError(name)
        return self.row[name]

    def __eq__(self, other):
        return type(self) is type(other) and self.row == other.row


@dataclass(eq=False)
class Genome(_Model):
    @cached_property
    def species_and_strain(self) -> tuple[str, str]:
        df = self.release.spark.createDataFrame([(self.row.sci_name or "",)], "n string")
        return tuple(df.select(strings.species_part("n"), strings.strain_part("n")).first())

    @cached_property
    def lineage(self) -> list[str]:
        return [r.name for r in self.release.lineage(self.row.taxid).orderBy("dist").collect()]

    @property
    def kingdom(self) -> str:
        """Name at the end of the lineage."""
        return self.lineage[-1] if self.lineage else ""

    @cached_property
    def nr_genes(self) -> int:
        return self.release.main_isoforms(self.row.species_code).count()

    @property
    def release_date(self) -> str | None:
        return self.row.date.strftime("%Y-%b-%d") if self.row.date else None

    def chromosome_length(self, chromosome: str) -> int | None:
        hit = summary.chromosome_lengths(self.release.proteins_of(self.row.species_code)).where(F.col("chromosome") == chromosome).first()
        return hit.length if hit else None


@dataclass(eq=False)
class AncestralGenome(_Model):
    """A clade: row of the taxonomy."""

    @cached_property
    def extant_genomes(self) -> list[str]:
        return sorted(r.species_code for r in self.release.extant_genomes(self.row.taxid).select("species_code").collect())

    @cached_property
    def nr_genes(self) -> int:
        return self.release.hogs_at_level(self.row.name).count()

    @cached_property
    def newick(self) -> str:
        below = hierarchy.subtree(self.release.tree, self.row.taxid).select("taxid")
        return hierarchy.to_newick(self.release.taxonomy.join(below, "taxid", "left_semi"))


@dataclass(eq=False)
class Protein(_Model):
    @property
    def is_main_isoform(self) -> bool:
        return self.row.alt_splice in (0, self.row.entry_nr)

    @property
    def main_isoform(self) -> int:
        return self.row.alt_splice or self.row.entry_nr

    @cached_property
    def alternative_isoforms(self) -> list[int]:
        return sorted(r.entry_nr for r in self.release.isoforms(self.row.entry_nr).collect() if r.entry_nr != self.row.entry_nr)

    @property
    def hog_family_nr(self) -> int:
        """0 for an entry without a group."""
        return self.row.fam or 0

    @cached_property
    def genome(self) -> Genome:
        return self.release.genome(self.row.species_code)

    @cached_property
    def _texts(self) -> Row | None:
        return self.release.sequence(self.row.entry_nr).first()

    @property
    def sequence(self) -> str:
        return self._texts.seq if self._texts else ""

    @property
    def cdna(self) -> str:
        return self._texts.cdna if self._texts else ""

    @property
    def description(self) -> str:
        return self._texts.description if self._texts else ""

    @property
    def gc_content(self) -> float:
        c = self.cdna or ""
        n = sum(c.count(x) for x in "ACGT")
        return (c.count("G") + c.count("C")) / n if n else 0.0

    @cached_property
    def exons(self) -> ExonStructure:
        rows = self.release.exons(self.row.entry_nr).collect()
        return ExonStructure([Exon(r.start, r.end, r.strand) for r in rows])


@dataclass(eq=False)
class Hog(_Model):
    @cached_property
    def nr_members(self) -> int:
        return self.release.hog_members(self.row.hog_id).count()

    @cached_property
    def levels(self) -> list[str]:
        return sorted(r.level for r in self.release.table("hog_level").where(F.col("hog_id") == self.row.hog_id).select("level").collect())


@dataclass(eq=False)
class FlatGroup(_Model):
    """Row of the group metadata."""

    @cached_property
    def members(self) -> list[int]:
        return sorted(r.entry_nr for r in self.release.flat_group_members(self.row.group_nr).select("entry_nr").collect())

    def __len__(self):
        return len(self.members)


@dataclass(eq=False)
class Annotation(_Model):
    """Row of the term annotations."""

    @property
    def term_id(self) -> str:
        return f"GO:{self.row.term_nr:07d}"

    @cached_property
    def term(self) -> Row | None:
        return self.release.table("go_term").where(F.col("term_nr") == self.row.term_nr).first()


@dataclass(eq=False)
class PairwiseRelation(_Model):
    @property
    def rel_label(self) -> str:
        return REL_TYPES[self.row.rel_type] if 0 <= self.row.rel_type < len(REL_TYPES) else "n/a"

    @cached_property
    def ends(self) -> tuple[Protein, Protein]:
        return self.release.entry(self.row.entry_nr1), self.release.entry(self.row.entry_nr2)


@dataclass(frozen=True, order=True)
class Exon:
    start: int
    end: int
    strand: int = 1

    def __str__(self):
        span = f"{self.start}..{self.end}"
        return f"complement({span})" if self.strand < 0 else span

    def as_dict(self) -> dict:
        return {"start": self.start, "end": self.end, "strand": "-" if self.strand < 0 else "+"}


@dataclass
class ExonStructure:
    exons: list[Exon]

    def __len__(self):
        return len(self.exons)

    def __str__(self):
        ordered = sorted(self.exons, reverse=any(e.strand < 0 for e in self.exons))
        text = ", ".join(map(str, ordered))
        return f"join({text})" if len(ordered) > 1 else text

    def as_list_of_dict(self) -> list[dict]:
        return [e.as_dict() for e in sorted(self.exons)]
