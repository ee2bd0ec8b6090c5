"""DataFrame operators over word boxes, annotations, curves and images."""
