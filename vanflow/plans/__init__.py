"""Multi-operator jobs: training, inference, recommendation, feedback."""
