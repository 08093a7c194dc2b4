"""Column functions: alleles, numbers, read support, annotations, reads, the copy-number model; distributions in numpy."""
