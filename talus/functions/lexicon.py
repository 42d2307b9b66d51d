"""Fixed values of the matcher: words that tell nothing, phrases that count as one term, related terms and names of skills."""

from __future__ import annotations

# Words that are no terms.
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "into", "over", "under",
    "using", "use", "study", "studies", "research", "lab", "group", "work", "works",
    "working", "method", "methods", "approach", "approaches", "analysis", "model",
    "models", "system", "systems", "data", "new", "based", "also", "can", "may",
    "will", "our", "their", "these", "those", "such", "well", "more", "been",
    "being", "have", "has", "had", "are", "was", "were", "is", "be", "an", "a",
    "of", "in", "to", "on", "by", "as", "or", "at", "it", "its",
)

# Words of award abstracts that are no keywords.
AWARD_STOPWORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "was", "are", "were", "been", "be", "have", "has", "had",
    "do", "does", "did", "will", "would", "could", "should", "may", "might", "must", "this", "that", "these", "those", "it", "its", "they", "their", "them", "we", "our",
    "you", "your", "he", "she", "his", "her", "which", "who", "whom", "what", "where", "when", "why", "how", "all", "each", "every", "both", "few", "more", "most", "other",
    "some", "such", "no", "not", "only", "same", "so", "than", "too", "very", "can", "just", "also", "now", "new", "one", "two", "first", "well", "way", "use", "used",
    "using", "work", "project", "research", "study", "studies", "develop", "developed", "program", "award", "nsf", "support", "supported", "provide", "provides", "include",
    "including", "based", "approach", "approaches", "understanding", "understand",
)

# Phrases that count as one term of more weight.
PHRASES = (
    "machine learning", "deep learning", "neural network", "neural networks", "natural language processing", "computer vision", "reinforcement learning",
    "graph neural", "language model", "language models", "large language", "generative ai", "diffusion model", "transformer model", "attention mechanism",
    "single cell", "stem cell", "stem cells", "gene expression", "gene editing", "genome wide", "protein structure", "drug discovery", "drug development",
    "clinical trial", "clinical trials", "cell signaling", "immune system", "cancer biology", "tumor microenvironment", "gene therapy", "rna sequencing",
    "mass spectrometry", "cryo em", "x ray",
    "organic synthesis", "materials science", "renewable energy", "solar cell", "solar cells", "energy storage", "carbon capture", "nanomaterials", "drug delivery",
    "biomedical engineering", "tissue engineering", "medical device", "medical devices", "control systems", "signal processing", "image processing",
    "data science", "data analysis", "big data", "high performance", "distributed systems", "cloud computing", "quantum computing",
    "clinical research", "public health", "health outcomes", "medical imaging", "precision medicine", "personalized medicine",
    "human computer", "user experience", "decision making",
)

# Fields in order, each with the terms that a text about it is taken to mean as well.
ONTOLOGY = {
    "machine learning": ("ml", "deep learning", "neural networks", "artificial intelligence", "ai", "statistical learning"),
    "deep learning": ("neural networks", "cnn", "rnn", "transformer", "lstm", "gan", "diffusion"),
    "natural language processing": ("nlp", "language models", "text mining", "computational linguistics", "llm", "information retrieval"),
    "computer vision": ("image processing", "object detection", "image segmentation", "visual recognition", "scene understanding"),
    "reinforcement learning": ("rl", "policy gradient", "q-learning", "multi-agent", "decision making"),
    "robotics": ("autonomous systems", "manipulation", "motion planning", "control systems", "human-robot interaction"),
    "artificial intelligence": ("ai", "machine learning", "intelligent systems", "cognitive computing"),
    "genomics": ("sequencing", "dna", "rna", "genome", "transcriptomics", "whole genome", "exome"),
    "single cell": ("scrna-seq", "single cell rna", "single cell sequencing", "scatac", "single cell analysis"),
    "proteomics": ("mass spectrometry", "protein", "peptide", "proteome", "protein expression"),
    "bioinformatics": ("computational biology", "biological data analysis", "sequence analysis", "biological databases"),
    "systems biology": ("network biology", "pathway analysis", "biological networks", "omics integration"),
    "synthetic biology": ("genetic engineering", "metabolic engineering", "bioengineering", "gene circuits"),
    "immunology": ("immune system", "t cells", "b cells", "antibodies", "vaccine", "immunotherapy"),
    "neuroscience": ("brain", "neural", "cognitive", "neuroimaging", "neurobiology", "neurons"),
    "cancer": ("oncology", "tumor", "carcinoma", "metastasis", "cancer biology", "oncogene"),
    "microbiology": ("bacteria", "microbiome", "microbial", "pathogen", "infectious disease"),
    "structural biology": ("protein structure", "crystallography", "cryo-em", "structural determination", "molecular structure"),
    "cell biology": ("cellular", "cell signaling", "cell cycle", "membrane biology", "organelles"),
    "developmental biology": ("embryology", "morphogenesis", "stem cells", "differentiation", "organogenesis"),
    "genetics": ("heredity", "gene", "mutation", "inheritance", "mendelian", "genetic variation"),
    "molecular biology": ("dna", "rna", "protein", "gene expression", "molecular mechanisms"),
    "ecology": ("ecosystems", "biodiversity", "conservation", "environmental biology", "population dynamics"),
    "evolution": ("evolutionary biology", "phylogenetics", "natural selection", "adaptation", "speciation"),
    "organic chemistry": ("synthesis", "organic synthesis", "chemical reactions", "organic molecules"),
    "biochemistry": ("enzymes", "metabolism", "biochemical", "molecular biology", "protein chemistry"),
    "materials science": ("nanomaterials", "polymers", "materials engineering", "material properties", "composites"),
    "nanotechnology": ("nanoscale", "nanoparticles", "nanomedicine", "nano", "nanofabrication"),
    "drug discovery": ("pharmaceutical", "therapeutics", "drug development", "medicinal chemistry", "pharmacology"),
    "quantum computing": ("qubits", "quantum algorithms", "quantum information", "quantum mechanics"),
    "photonics": ("optics", "lasers", "optical", "photonic devices", "light"),
    "renewable energy": ("solar", "wind", "sustainable energy", "clean energy", "energy storage"),
    "biomedical engineering": ("medical devices", "biomechanics", "biomedical", "tissue engineering", "bme"),
    "electrical engineering": ("circuits", "electronics", "signals", "embedded systems"),
    "mechanical engineering": ("mechanics", "dynamics", "thermodynamics", "fluid mechanics"),
    "data science": ("data analysis", "analytics", "big data", "data mining", "statistical analysis"),
    "statistics": ("statistical methods", "probability", "bayesian", "inference", "regression"),
    "computational": ("computing", "algorithms", "numerical methods", "simulation", "modeling"),
    "clinical research": ("clinical trials", "patient outcomes", "medical research", "translational research"),
    "epidemiology": ("public health", "disease prevention", "population health", "health outcomes"),
    "medical imaging": ("radiology", "mri", "ct scan", "ultrasound", "diagnostic imaging"),
    "human-computer interaction": ("hci", "user experience", "ux", "interaction design", "usability"),
    "cognitive science": ("cognition", "perception", "attention", "memory", "decision making"),
}

# Skills, each with other names for it.
SKILLS = {
    "python": ("py", "python3", "python programming"),
    "r": ("r programming", "rstats", "r language"),
    "matlab": ("mathworks", "matlab programming"),
    "java": ("java programming", "jvm"),
    "javascript": ("js", "node", "nodejs", "typescript", "ts"),
    "c++": ("cpp", "c plus plus"),
    "sql": ("mysql", "postgresql", "database", "sqlite"),
    "tensorflow": ("tf", "keras"),
    "pytorch": ("torch",),
    "machine learning": ("ml", "sklearn", "scikit-learn"),
    "deep learning": ("dl", "neural networks"),
    "statistics": ("stats", "statistical analysis"),
    "data analysis": ("data analytics", "data science"),
    "bioinformatics": ("computational biology",),
    "microscopy": ("imaging", "confocal", "fluorescence microscopy"),
    "pcr": ("qpcr", "rt-pcr", "polymerase chain reaction"),
    "cell culture": ("tissue culture", "mammalian cell culture"),
    "crispr": ("gene editing", "crispr-cas9", "genome editing"),
    "sequencing": ("ngs", "next generation sequencing", "illumina"),
    "mass spec": ("mass spectrometry", "lcms", "gcms"),
    "western blot": ("immunoblot", "western blotting"),
    "flow cytometry": ("facs", "cell sorting"),
}
