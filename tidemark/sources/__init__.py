"""Readers and writers of text lines, SAM and BAM, BED and bedGraph, VCF and FASTA."""
