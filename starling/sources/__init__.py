"""Reading points, edges, labels and ready graphs."""
