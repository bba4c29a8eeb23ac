"""Declared schemas of the genome tables and of the files they are loaded from."""

from __future__ import annotations

BINS = "bin_id string, completeness double, contamination double, taxonomy string, n_contigs int, total_length long"
CONTIGS = "contig_id string, bin_id string, length int, gc_content double, is_circular boolean, taxonomy string"
PROTEINS = (
    "protein_id string, contig_id string, bin_id string, start int, end_coord int, strand string, gene_index int, "
    "sequence string, sequence_length int, gc_content double"
)
ANNOTATIONS = (
    "annotation_id long, protein_id string, source string, accession string, name string, description string, "
    "evalue double, score double, start_aa int, end_aa int"
)
LOCI = "locus_id string, locus_type string, contig_id string, start int, end_coord int, confidence double, metadata string"
LOCUS_PROTEINS = "locus_id string, protein_id string, position int"
FEATURE_STORE = "protein_id string, metric_name string, metric_value double, computed_at timestamp, version string"
PROTEIN_PREDICATES = "protein_id string, predicates array<string>, updated_at timestamp"
VOCABULARY = "predicate_id string, name string, description string, category string, parent string"
EVIDENCE = "hypothesis_id string, entry_id string, supports boolean, confidence double"
PROVENANCE = "entry_id string, query string, summary string, parents array<string>"

#: File layouts.
GENOME_MANIFEST = (
    "genomes array<struct<genome_id: string, taxonomy: struct<name: string, taxonomy: string, completeness: double, contamination: double>, "
    "n_contigs: int, total_length: long>>"
)
CLUSTERS_JSON = (
    "clusters array<struct<cluster_id: string, contig: string, start: int, `end`: int, bgc_type: string, "
    "product: string, protein_list: array<string>>>"
)
ARRAYS_JSON = (
    "arrays array<struct<id: string, contig: string, startCoordinate: int, endCoordinate: int, strand: string, metadata: map<string,string>>>"
)
CAZY_JSON = (
    "annotations array<struct<protein_id: string, cazyme_family: string, family_type: string, evalue: double, coverage: double, "
    "start_position: int, end_position: int, ec_number: string, substrate_prediction: string>>"
)
TAXONOMY_JSON = "taxonomy struct<species: string, genus: string>, completeness double, contamination double, ani double"
FINDINGS = (
    "id string, title string, category string, priority string, description string, summary string, "
    "evidence string, genes array<string>"
)
GFF = "seqid string, tool string, type string, start int, end_coord int, score string, strand string, phase string, attributes string"
