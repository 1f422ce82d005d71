"""Readers and writers of variant and annotation files."""

from helixframe.sources.bgen import read_bgen, read_bgen_blocks, write_bgen, write_bigbgen
from helixframe.sources.gff import read_gff
from helixframe.sources.plink import read_plink
from helixframe.sources.tabix import write_tabix_index
from helixframe.sources.vcf import read_vcf, read_vcf_lines
from helixframe.sources.vcf_write import write_bigvcf, write_vcf

__all__ = ["read_bgen", "read_bgen_blocks", "read_gff", "read_plink", "read_vcf", "read_vcf_lines", "write_bgen", "write_bigbgen", "write_bigvcf", "write_tabix_index", "write_vcf"]
